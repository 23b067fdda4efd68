import numpy as np
import pytest

from sievelake.llm import quality
from sievelake.llm.queries import QUERIES, SQL

from ..oracle import DATA, same

COMMON = ["the", "of", "and", "this", "that", "our", "was", "in", "à", "die", "der", "und", "le", "la"]
PROSE = "The committee of the region approved this plan and the council thanked our members for the work.\n"
LIST = "1. Northern harbour Kelby\n2. Local clinic Oldham\n3. Winter market Selby\n4. Rural bridge Tarn\n"
TABLE = "Kelby\t1200\t4410\t9921\nOldham\t3321\t87\t1200\nSelby\t5512\t9034\t71\n"
JUNK = "{x~0|;/k q}>z:\\b <w^\n;:{}|~ \\q/0 x<>z ^b{};\n"


def frames(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, cells int")
    return docs, spark.createDataFrame([("xx", w) for w in COMMON] + [("xx", None)], "lang string, word string")


def test_statistics_equal_sql(spark):
    assert same(spark, QUERIES["p8_stats"], SQL["p8_stats"])


def test_kinds(spark):
    texts = [PROSE * 5] * 30 + [LIST * 4] * 6 + [TABLE * 4] * 6 + [JUNK * 5] * 6 + [PROSE + LIST * 6, PROSE * 9 + LIST, "", None, " \r\n\t"]
    got = [r.kind for r in quality.classify(*frames(spark, texts)).orderBy("doc_id").collect()]
    assert got[:30] == ["prose"] * 30 and all(k not in ("prose", None) for k in got[30:48])
    assert got[48] not in ("prose", None) and got[49] == "prose" and got[50:] == [None, None, None]


def test_counts(spark):
    r = quality.statistics(*frames(spark, ["The café, of \r\n\r\nTHE # 12 ends.\rx", None, "𝔘 \U0001f600"])).orderBy("doc_id").collect()
    assert (r[0].n_words, r[0].n_lines, r[0].ended_share, r[0].common_share) == (7, 3, pytest.approx(1 / 3), pytest.approx(3 / 7))
    assert r[1].n_words == 0 and r[1].mean_word_length is None and (r[2].n_words, r[2].n_lines) == (1, 1)


def test_word_hashes_do_not_depend_on_place():
    common = quality.common_hashes(["harbour"])
    c = quality.Counts(["x harbour y", "harbour", "a b harbouR harbours"], common)
    assert c.common.tolist() == [1, 1, 1]


def test_mixture_separates():
    counts = np.zeros(quality.CELLS, np.int64)
    common = quality.common_hashes(COMMON)
    for text, n in ((PROSE, 1000), (LIST, 50), (TABLE, 40), (JUNK, 30)):
        np.add.at(counts, quality.Counts([text], common).cells(), n)
    odds, mixture = quality.line_odds(counts, common)
    assert 1 < mixture.rounds < quality.ROUNDS
    kinds = odds.argmax(1)
    of = lambda t: set(kinds[quality.Counts([t], common).cells()])
    assert of(PROSE) == {0} and 0 not in of(LIST) | of(TABLE) | of(JUNK)


def test_documents_of_their_own_mixture(spark):
    docs, words = frames(spark, [PROSE * 5] * 30 + [LIST * 4] * 6 + [TABLE * 4] * 6 + [JUNK * 5] * 6 + [None])
    common = quality.common_hashes(COMMON)
    mixture, label = quality.document_mixture(quality.analyse(docs, words), common)
    assert 1 < mixture.rounds < quality.ROUNDS and mixture.mean.shape == (5,) and set(label) == {0, 1, 2, 3}
    odds = [r.prose_odds for r in quality.classify(docs, words).orderBy("doc_id").collect()]
    assert min(odds[:30]) > 0.9 and max(odds[30:48]) < 0.1 and odds[48] is None


def test_long_and_empty(spark):
    docs, words = frames(spark, [PROSE * 30_000, PROSE])
    assert [r.kind for r in quality.classify(docs, words).orderBy("doc_id").collect()] == ["prose", "prose"]
    assert quality.classify(docs.limit(0), words).count() == 0


def test_all_queries_run(spark):
    for name in QUERIES:
        QUERIES[name](spark, DATA).count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, QUERIES[name], SQL[name])
