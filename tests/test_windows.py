import pytest

from sievelake.operators import reports, windows
from sievelake.operators.scan import scan
from sievelake.plans.rules import Extractor, Matcher, Request, Rule, choose, ignored, problems


def hits(spark, data, m, **options):
    blocks = spark.createDataFrame([("b", bytearray(data))], "label string, content binary")
    f = windows.scan_blocks(blocks, [Rule("r", requests=[Request(matchers=[m])])], window=1000, overlap=100, **options).collect()
    return sorted((h.byte_offset, h.value) for r in f for v in r.matches.values() for h in v)


def planted(*places):
    data = bytearray(b"." * 2500)
    for at, x in places:
        data[at : at + len(x)] = x
    return data


@pytest.mark.parametrize("kind", ["word", "binary"])
def test_hits_of_overlaps_count_once_under_each_condition(spark, kind):
    value = lambda x: x.decode() if kind == "word" else x.hex()
    matcher = lambda xs, **o: Matcher(kind, words=[x.decode() for x in xs], binary=[x.hex() for x in xs], **o)
    data = planted((600, b"bbbb"), (990, b"aaaa"), (1850, b"aaaa"))
    both = [(600, value(b"bbbb")), (990, value(b"aaaa")), (1850, value(b"aaaa"))]
    assert hits(spark, data, matcher([b"aaaa", b"bbbb"], condition="and")) == both
    assert hits(spark, data, matcher([b"aaaa", b"cccc"], condition="and")) == []
    assert hits(spark, data, matcher([b"aaaa", b"bbbb"])) == both[1:]
    assert hits(spark, data, matcher([b"bbbb", b"aaaa"])) == both[:1]
    assert hits(spark, data, matcher([b"cccc", b"bbbb", b"aaaa"], match_all=True)) == both


def test_patterns_in_windows(spark):
    data = planted((895, b"key=1234"), (950, b"key=5"), (2400, b"KEY=7"))
    assert hits(spark, data, Matcher("regex", regex=["(?i)key=[0-9]+"])) == [(895, "key=1234"), (950, "key=5"), (2400, "KEY=7")]
    assert hits(spark, b"aaaa", Matcher(words=["AA"], case_insensitive=True)) == [(0, "aa"), (1, "aa"), (2, "aa")]
    assert hits(spark, b"", Matcher(words=["a"])) == []


def test_merged_requests_keep_matches_and_names(spark):
    docs = spark.createDataFrame([("d1", "alpha 12\nbeta 34\n"), ("d2", "beta 5\n")], "label string, content string")
    request = lambda w: Request(matchers=[Matcher(name="w", words=[w])], extractors=[Extractor(name="n", regex=[rf"{w} (\d+)"], group=1)])
    f = scan(docs, [Rule("r", "R", "low", requests=[request("beta"), request("alpha")])])
    got = {r.label: r for r in reports.merge_rules(f).collect()}
    assert [(h.value, h.line) for h in got["d1"].matches["w"]] == [("beta", 2), ("alpha", 1)]
    assert got["d1"].named_extracts == {"n": ["34", "12"]} and got["d1"].output_extracts == ["34", "12"] and got["d2"].named_extracts == {"n": ["5"]}
    every = reports.merge_rules(f, None).collect()
    assert len(every) == 1 and every[0].named_extracts == {"n": ["34", "5", "12"]}


def test_refused_and_reported(spark):
    q = Request(matchers=[Matcher("dsl", dsl=["len(raw) > 3 || contains(body, 'x')", "md5(raw) == 'x'"]), Matcher(words=["{{name}}", "ok"])])
    assert [what.split()[0] for _, what in problems([Rule("r", requests=[q])])] == ["expression", "variables"]
    docs = spark.createDataFrame([("d", "text")], "label string, content string")
    with pytest.raises(ValueError):
        scan(docs, [Rule("r", requests=[Request(extractors=[Extractor("kval", kval=["path"])])])], engine="arrow")


def test_expression_precedence(spark):
    docs = spark.createDataFrame([("d", "text")], "label string, content string")
    rule = lambda e: Rule("r", requests=[Request(matchers=[Matcher("dsl", dsl=[e])])])
    assert scan(docs, [rule("len(raw) > 1 || len(raw) > 9 && len(raw) > 99")]).count() == 1
    assert scan(docs, [rule("len(raw) > 9 && len(raw) > 1 || len(raw) > 99")]).count() == 0


def test_choice_and_reports(spark, tmp_path):
    rules = [Rule("a", category="keys"), Rule("b", category="web"), Rule("c", category="web")]
    assert [r.id for r in choose(rules, categories=["web"], exclude_ids=ignored("# known\nc  # later\n\n"))] == ["b"]
    f = spark.createDataFrame([("a", "p", "low"), ("b", "q", "medium"), ("a", "p", "odd")], "template_id string, path string, severity string")
    assert reports.fails(f, "medium") and not reports.fails(f, "high")
    reports.save_baseline(f, f"file://{tmp_path}/base", ["template_id", "path"])
    assert reports.new_findings(f, spark.read.parquet(f"file://{tmp_path}/base"), ["template_id", "path"]).count() == 0
