"""Most frequent values by exact prefix refinement.

Values are hashed to 64 bits. Counting all hash prefixes of a few bits takes
memory for that many counters only, whatever the number of distinct values. A
value can be frequent only if its prefix is, so the prefixes that cannot beat
the bound are dropped and the others lengthened, until the few values behind
the remaining prefixes are counted in full. The result is exact.

The bound is a share of all rows, or the kth largest exact count of one random
row's value per prefix: a lower bound of the kth count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import table

#: Prefixes counted at once and field; the memory of every step is bounded by it.
COUNTERS = 1 << 17
FIRST_BITS = 12


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits).cast("long")


def _within(df: DataFrame, kept: list[tuple[str, int]], bits: int) -> DataFrame:
    """Rows whose prefix is among ``kept``, which COUNTERS bounds."""
    spark = df.sparkSession
    keys = spark.createDataFrame(kept, "field_name string, prefix long")
    return df.withColumn("prefix", _prefix(bits)).join(F.broadcast(keys), ["field_name", "prefix"], "left_semi")


def frequent(items: DataFrame, share: float | None = None, k: int | None = None, counters: int = COUNTERS) -> DataFrame:
    """``(field_name, item_text, n, n_total)``: values with at least ``share`` of their field's rows, or its ``k`` most frequent.

    ``items`` has field_name and item_text; null and empty values count neither
    as items nor in the total. Ties at the kth place are all returned. An empty
    table gives an empty result. ``counters`` bounds the counters of a step.
    """
    spark = items.sparkSession
    rows = items.where("item_text is not null and item_text <> ''").select("field_name", "item_text", F.xxhash64("item_text").alias("h"))
    drawn = rows.withColumn("draw", F.rand(7) if share is None else F.lit(0.0))
    first = drawn.groupBy("field_name", _prefix(FIRST_BITS).alias("prefix")).agg(F.count("*").alias("n"), F.max_by("h", "draw").alias("witness")).collect()
    totals: dict[str, int] = {}
    for r in first:
        totals[r.field_name] = totals.get(r.field_name, 0) + r.n
    out_schema = "field_name string, item_text string, n long, n_total long"
    if not totals:
        return spark.createDataFrame([], out_schema)
    if share is not None:
        bound = {f: max(1, math.ceil(share * n - 1e-9)) for f, n in totals.items()}
    else:
        # At most 2 ** FIRST_BITS witnesses a field: small enough to broadcast.
        witnesses = spark.createDataFrame([(r.field_name, r.witness) for r in first], "field_name string, h long")
        exact = rows.join(F.broadcast(witnesses), ["field_name", "h"], "left_semi").groupBy("field_name", "h").count().collect()
        bound = {}
        for f in totals:
            counts = sorted((r["count"] for r in exact if r.field_name == f), reverse=True)
            bound[f] = counts[k - 1] if len(counts) >= k else 1
    bits, counted = FIRST_BITS, [(r.field_name, r.prefix, r.n) for r in first]
    while True:
        kept = [(f, p) for f, p, n in counted if n >= bound[f]]
        if not kept:
            return spark.createDataFrame([], out_schema)
        per_field = max(sum(1 for f, _ in kept if f == x) for x in totals)
        light = max(totals.values()) / 2**bits * per_field  # values that merely share a kept prefix
        if light <= counters or bits >= 60:
            break
        step = max(1, min(60 - bits, int(math.log2(max(2, counters / per_field)))))
        inside = _within(rows, kept, bits)
        bits += step
        counts = inside.groupBy("field_name", _prefix(bits).alias("longer")).agg(F.count("*").alias("n"))
        limits = F.create_map(*[x for f, b in bound.items() for x in (F.lit(f), F.lit(b))])
        counted = [tuple(r) for r in counts.where(F.col("n") >= limits[F.col("field_name")]).collect()]
    full = _within(rows, kept, bits).groupBy("field_name", "item_text").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(f, bound[f], n) for f, n in totals.items()], "field_name string, bound long, n_total long")
    found = full.join(F.broadcast(known), "field_name").where("n >= bound")
    if share is None:
        found = found.withColumn("place", F.rank().over(Window.partitionBy("field_name").orderBy(F.desc("n")))).where(F.col("place") <= k)
    return found.select("field_name", "item_text", "n", "n_total")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "file_matches").select(F.lit("match_data").alias("field_name"), F.col("match_data").alias("item_text"))
    e = table(spark, sf_dir, "findings").select(F.lit("extracts").alias("field_name"), F.explode("extracts.value_text").alias("item_text"))
    return m.unionByName(e)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(_items(spark, sf_dir), share=0.005).select("field_name", "item_text")


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(_items(spark, sf_dir), k=20).select("field_name", "item_text", "n")


_ITEMS = """(select 'match_data' as field_name, match_data as item_text from file_matches
    union all select 'extracts', x.value_text from (select unnest(extracts) as x from findings))"""
SQL = {
    "p5_found": f"""
        with i as (select * from {_ITEMS} where item_text is not null and item_text <> ''),
        t as (select field_name, count(*) as total from i group by field_name)
        select i.field_name, item_text from i join t on i.field_name = t.field_name
        group by i.field_name, item_text, total having count(*) >= 0.005 * total""",
    "p5_top": f"""
        with c as (select field_name, item_text, count(*) as n from {_ITEMS} where item_text is not null and item_text <> '' group by all)
        select field_name, item_text, n from (select *, rank() over (partition by field_name order by n desc) as place from c) where place <= 20""",
}
