from collections import Counter

import pytest

from sievelake.llm.frequent import frequent

ROWS = [("a", f"v{i % 700}" if i % 5 else "hot", "clash") for i in range(4000)] + [("a", None, ""), ("a", "", ""), ("b", "only", ""), ("b", "x" * 100_000, "")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "field_name string, item_text string, h string")


def exact(field):
    return Counter(t for f, t, _ in ROWS if f == field and t)


@pytest.mark.parametrize("counters", [4, 64, 1 << 17])
def test_share(spark, counters):
    got = {(r.field_name, r.item_text): r.n for r in frequent(frame(spark), share=0.002, counters=counters).collect()}
    want = {(f, t): n for f in "ab" for t, n in exact(f).items() if n >= 0.002 * sum(exact(f).values())}
    assert got == want


@pytest.mark.parametrize("counters", [64, 1 << 17])
def test_top_with_ties(spark, counters):
    got = {(r.field_name, r.item_text): r.n for r in frequent(frame(spark), k=3, counters=counters).collect()}
    want = {}
    for f in "ab":
        c = exact(f)
        kth = sorted(c.values(), reverse=True)[:3][-1]
        want |= {(f, t): n for t, n in c.items() if n >= kth}
    assert got == want


def test_nothing(spark):
    assert frequent(frame(spark, []), share=0.1).count() == 0 and frequent(frame(spark, [("a", None, "")]), k=2).count() == 0
