import random

import pytest
from pyspark.sql import functions as F

from sievelake.llm import mixing

RND = random.Random(2)
TARGETS = [(1, "a", 3.0, 1, 0.5), (1, "b", 1.0, 4, 0.5), (1, "gone", 1.0, 2, 0.5), (2, "b", None, None, 1.0), (2, "A", 1.0, None, 0.2), (None, "a", 1.0, 1, 1.0), (3, None, 1.0, 1, 1.0)]
TARGET_SCHEMA = "mix_id int, source string, weight double, max_repeats int, budget_ratio double"


def docs(n=600):
    source = lambda i: " A" if i % 3 else "b" if i % 2 else None
    return [(i, source(i), "word " * RND.randrange(1, 60), 1) for i in range(n)] + [(9001, "a", None, 1), (9002, "b", "", 1)]


def frames(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int"), spark.createDataFrame(TARGETS, TARGET_SCHEMA)


def test_shares_caps_and_shortfalls(spark):
    taken, report = mixing.mix(*frames(spark, docs()))
    largest = 70
    rows = {(r.mix_id, r.source): r for r in report.collect()}
    assert set(rows) == {(1, "a"), (1, "b"), (1, "gone"), (2, "b"), (2, "A")}
    for (mix, source), r in rows.items():
        if r.short:
            assert r.actual_tokens == r.available_tokens
        else:
            assert abs(r.actual_tokens - r.target_tokens) < largest
    assert rows[1, "gone"].short and not rows[1, "a"].short and rows[2, "b"].actual_tokens == 0
    got = taken.collect()
    assert len({(r.mix_id, r.source, r.doc_id) for r in got}) == len(got)
    assert max(r.copies for r in got if (r.mix_id, r.source) == (1, "b")) <= 4 and max(r.copies for r in got if r.source == "a") == 1


def test_short_is_decided_by_what_was_taken(spark):
    d, t = frames(spark, docs())
    tokens = mixing.count_tokens(d)
    plans = mixing.plan(tokens, t.where("mix_id = 1").withColumn("budget_ratio", F.lit(9.0)))
    taken = mixing.allocate(tokens, plans)
    short = lambda x: {r.source for r in mixing.report(plans, x).where("short").collect()}
    assert short(taken) == {"a", "b", "gone"}
    one = taken.where("source = 'a'").agg(F.min("doc_id")).collect()[0][0]
    assert short(taken.where(F.col("doc_id") != one)) == {"b", "gone"}  # something is left of a: nothing is known to be missing
    assert short(taken.withColumn("copies", F.col("copies") * 99)) == {"gone"}


def test_repeatable_and_partitioned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 2)  # several levels of the tree
    d, t = frames(spark, docs(300))
    tokens = mixing.count_tokens(d.repartition(13, "doc_id"))
    plans = mixing.plan(tokens, t)
    runs = [sorted(map(tuple, mixing.allocate(tokens, plans).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    total = {r.source: r.target_tokens for r in plans.where("mix_id = 1").collect()}
    size = sum(n * c for m, s, _, n, c in runs[0] if (m, s) == (1, "a"))
    assert abs(size - total["a"]) < 70


def test_pivot_keeps_size_and_expectation():
    sums, n = [0.0, 0.0], 4000
    for seed in range(n):
        left, done = mixing.pivot((1, 30, 0, 0.4), (2, 50, 1, 0.7), seed)
        size = sum(t * c for _, t, c in done) + (left[1] * (left[2] + left[3]) if left else 0)
        assert size == pytest.approx(30 * 0.4 + 50 * 1.7)
        copies = {i: c for i, _, c in done} | ({left[0]: left[2] + left[3]} if left else {})
        sums = [sums[0] + copies[1], sums[1] + copies[2]]
    assert sums[0] / n == pytest.approx(0.4, abs=0.03) and sums[1] / n == pytest.approx(1.7, abs=0.03)


def test_empty(spark):
    taken, report = mixing.mix(*frames(spark, []))
    assert taken.count() == 0 and all(r.actual_tokens == 0 for r in report.collect())
    d, t = frames(spark, docs(20))
    taken, report = mixing.mix(d, t.where("false"))
    assert taken.count() == 0 and report.count() == 0
