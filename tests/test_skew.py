import datetime as dt

from pyspark.sql import functions as F

from sievelake.operators.skew import heavy_keys, per_key

AT = dt.datetime(2020, 1, 1)
SCHEMA = "id long, k string, vs array<string>, at timestamp_ntz, n_rows int"


def run(spark, rows, partitions=7):
    df = spark.createDataFrame(rows, SCHEMA)
    out = per_key(df, {"k": F.col("k")}, F.col("id"), F.col("vs"), F.col("at"), partitions).collect()
    return {r.key_value: (r.n_rows, r.n_values, r.first_at, r.last_at) for r in out}


def test_hot_key_and_hot_value(spark):
    rows = [(i, "hot" if i % 3 else f"cold{i % 50}", ["same", f"v{i % 17}", None], AT + dt.timedelta(hours=i), 0) for i in range(3000)]
    want = {}
    for i, k, vs, at, _ in rows:
        n, s, lo, hi = want.get(k, (0, set(), at, at))
        want[k] = (n + 1, s | {v for v in vs if v}, min(lo, at), max(hi, at))
    want = {k: (n, len(s), lo, hi) for k, (n, s, lo, hi) in want.items()}
    for partitions in (1, 7, 40):
        assert run(spark, rows, partitions) == want


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, ["a"], AT, 0), (2, "x", None, None, 0), (3, "x", [], AT, 0), (3, "x", [], AT, 0), (4, "y", [None], None, 0), (5, "", ["q", "q"], AT, 0)]
    assert run(spark, rows) == {"x": (3, 0, AT, AT), "y": (1, 0, None, None), "": (1, 1, AT, AT)}
    assert run(spark, []) == {}


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "key_value string, n_rows long")
    assert [r.key_value for r in heavy_keys(df, 100, 0.02).collect()] == ["a"]
