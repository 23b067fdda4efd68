import itertools
import random
import re
import time

import numpy as np

from sievelake.llm import leaks

RND = random.Random(4)
VOCABULARY = ["".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RND.randrange(3, 9))) for _ in range(400)]
FORMULA = "i thank the honourable member for this very important question today"


def passage(n=40):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def test_words():
    assert leaks.words("Élan vi\u00adtal — STRASSE straße (Beifall)\nmo-\nving [x (y) z] 3,5") == ["elan", "vital", "strasse", "strasse", "moving", "3", "5"]
    assert leaks.words(None) == leaks.words("") == leaks.words(" \r\n") == []
    assert leaks.words("in-\r\nquiry ca\u200bble \x1f \x1e") == ["inquiry", "cable"]


def test_readings_of_divided_words():
    (ids, divided), (other, none) = leaks.Encoder(["north", "south", "inquiry", "a"]).encode(["north-\nsouth a in-\nquiry a", "a south"])
    n = {w: leaks.number(w) for w in ("north", "south", "inquiry", "a")}
    assert ids.tolist() == [n["north"], n["south"], n["a"], 0, 0, n["a"]] and divided == [(0, 2, 0), (3, 2, n["inquiry"])]
    assert other.tolist() == [n["a"], n["south"]] and none == []
    got = [(r.tolist(), p.tolist()) for r, p in leaks.readings(ids, divided)]
    assert ([n["north"], n["south"], n["a"], n["inquiry"], n["a"]], [0, 1, 2, 3, 5]) in got and len(got) == 4


def test_align_equals_plain_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 20)), rng.integers(1, 6, rng.integers(1, 30))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        run = np.zeros_like(h)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        assert leaks.align(a, b) == (h.max(), run.max())


def corpus():
    items = [(i, f"{FORMULA} {passage()}" if i % 3 == 0 else passage()) for i in range(30)] + [(30, None), (31, ""), (32, "short one")]
    docs = []
    for d in range(120):
        text = passage(60)
        if d % 4 == 0:
            src = items[d % 30][1].split()
            at, n = RND.randrange(0, 20), RND.choice([8, 11, 12, 13, 20])
            part = src[at : at + n]
            if d % 12 == 0:  # two words with a hyphen between, which the item knows as two
                part[1] = f"{part[1]}-\n{part.pop(2)}"
            if d % 8 == 0:
                part[len(part) // 2] = part[len(part) // 2][:2] + "-\r\n" + part[len(part) // 2][2:]
            part.insert(3, "(Applause)")
            text = f"{passage(10)} {' '.join(part).upper()} {passage(10)}"
        if d % 5 == 0:
            text = f"{FORMULA}. {text}"
        docs.append((d, text, 1))
    return items, docs + [(900, None, 1), (901, "", 1), (902, passage(20_000) + " " + items[1][1], 1), (1, docs[1][1], 1)]


def brute(items, docs):
    """Every reading of every division, tried one by one."""
    out = set()
    for d, t, _ in docs:
        grams, parts = set(), re.split("-\r?\n", t or "")
        for glue in itertools.product(["", " "], repeat=len(parts) - 1):
            ws = leaks.words("".join(x + g for x, g in zip(parts, [*glue, ""])))
            grams |= {tuple(ws[k : k + 12]) for k in range(len(ws) - 11)}
        out |= {(d, i) for i, p in items for ps in [leaks.words(p)] if any(tuple(ps[k : k + 12]) in grams for k in range(len(ps) - 11))}
    return out


def test_equals_brute_force(spark):
    items, docs = corpus()
    df, ev = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, passage string")
    want = brute(items, docs)
    assert want
    for edited in (True, False):
        got = {(r.doc_id, r.item_id) for r in leaks.leaks(df, ev, edited=edited).where("longest_run >= 12").collect()}
        assert got == want
    assert any("-\n" in t for d, t, _ in docs if t and d in {x for x, _ in want})


def test_a_pair_depends_on_its_two_texts_only(spark):
    items, docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    every = {tuple(r) for r in leaks.leaks(df, spark.createDataFrame(items, "item_id long, passage string")).collect()}
    for k in (0, 8):
        alone = {tuple(r) for r in leaks.leaks(df, spark.createDataFrame(items[k : k + 1], "item_id long, passage string")).collect()}
        assert alone and alone == {r for r in every if r[1] == k}


def test_long_rulers_take_no_time():
    for text in ("-" * 1_000_000, "a-" * 500_000, "(" * 1_000_000, "- " * 500_000):
        began = time.time()
        leaks.words(text)
        assert time.time() - began < 5


def test_edited_copies_are_scored(spark):
    words = passage(40).split()
    edited = [w if k % 9 else "changed" for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(edited)), (2, passage(40))], "doc_id long, text string")
    r = leaks.leaks(df, spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string")).collect()
    assert [(x.doc_id, x.item_id, x.longest_run) for x in r] == [(1, 7, 8)] and r[0].score > 50


def test_aligning_in_lots_changes_nothing():
    rng = np.random.default_rng(2)
    a = [rng.integers(1, 6, rng.integers(1, 20)) for _ in range(200)]
    b = [rng.integers(0, 6, n) for n in rng.integers(0, 900, 200)]
    scores, longest = leaks.align_all(a, b)
    assert [leaks.align(x, y) for x, y in zip(a, b)] == list(zip(scores, longest))


def test_frequent_edited_copies_are_scored(spark):
    words = passage(40).split()
    copy = " ".join(w if k % 9 else "changed" for k, w in enumerate(words))
    other = " ".join(words[1:6])  # makes one seed more frequent than the others
    docs = [(d, copy if d < 40 else other if d == 40 else passage(40)) for d in range(100)]
    r = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string")).collect()
    assert {x.doc_id for x in r if x.score > 50} == set(range(40)) and {x.doc_id for x in r} == set(range(41))


def test_scores_of_a_change_in_every_fifth_word(spark, tmp_path):
    words = passage(40).split()
    copy = " ".join(w if k % 5 else "changed" for k, w in enumerate(words))
    spark.createDataFrame([(d, copy if d < 9 else passage(40)) for d in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert {r.doc_id for r in leaks.p6_scores(spark, str(tmp_path)).collect()} == set(range(9))


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    ev = spark.createDataFrame([(1, passage())], "item_id long, passage string")
    assert leaks.leaks(none, ev).count() == 0 and leaks.leaks(some, ev.limit(0)).count() == 0
