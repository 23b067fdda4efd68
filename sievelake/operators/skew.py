"""Per-key results where a few keys hold most rows.

Rows are range-partitioned on the composite of key and secondary order. Spark
samples the quantiles of the *composite*, so a heavy key spans as many
partitions as its rows need while light keys share one. Each sorted partition
is reduced to one partial state per key it touches; the states of a key that
crosses partition boundaries are then stitched in partition order. Only those
states, a handful per partition and key, are grouped by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import table

_STATE = (
    "key_kind string, key_value string, part int, n_rows long, n_values long, "
    "first_h1 long, first_h2 long, last_h1 long, last_h2 long, first_at timestamp_ntz, last_at timestamp_ntz"
)


def _merge(a: dict, b: dict) -> dict:
    """The state of two pieces of one key's run, ``a`` before ``b``."""
    joint = a["last_h1"] is not None and (a["last_h1"], a["last_h2"]) == (b["first_h1"], b["first_h2"])
    known = lambda f, *x: f([v for v in x if v is not None], default=None)
    out = a | {"n_rows": a["n_rows"] + b["n_rows"], "n_values": a["n_values"] + b["n_values"] - joint}
    for h in ("h1", "h2"):
        out["first_" + h] = a["first_" + h] if a["first_h1"] is not None else b["first_" + h]
        out["last_" + h] = b["last_" + h] if b["last_h1"] is not None else a["last_" + h]
    return out | {"first_at": known(min, a["first_at"], b["first_at"]), "last_at": known(max, a["last_at"], b["last_at"])}


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial state per key of a sorted partition, batch after batch.

    The last key of a batch may go on in the next, so its state is held back.
    """
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        states = _runs(b)
        if held is not None:
            key = lambda x, i: (x.column(0)[i].as_py(), x.column(1)[i].as_py())
            if key(held, 0) == key(states, 0):
                merged = pa.RecordBatch.from_pylist([_merge(held.to_pylist()[0], states.slice(0, 1).to_pylist()[0])], schema=states.schema)
                states = merged if states.num_rows == 1 else pa.Table.from_batches([merged, states.slice(1)]).combine_chunks().to_batches()[0]
            else:
                yield held
        if states.num_rows > 1:
            yield states.slice(0, states.num_rows - 1)
        held = states.slice(states.num_rows - 1)
    if held is not None:
        yield held


def _runs(b: pa.RecordBatch) -> pa.RecordBatch:
    """One state per run of equal keys in a batch."""
    n = b.num_rows
    kind, key = b.column("key_kind"), b.column("key_value")
    same = lambda c: pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], ~(same(kind) & same(key))]))
    ends = np.append(starts[1:], n)
    h1, h2 = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
    has = b.column("h1").is_valid().to_numpy(zero_copy_only=False)
    count = b.column("one").to_numpy(zero_copy_only=False).astype(np.int64)
    # Nulls sort first: a value is new where it differs from the row before or begins the key.
    fresh = has & np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | ~has[:-1]])
    fresh[starts] = has[starts]
    us, low, high = b.column("at").cast(pa.int64()), np.iinfo(np.int64).max, np.iinfo(np.int64).min
    first_at = np.minimum.reduceat(us.fill_null(low).to_numpy(zero_copy_only=False), starts)
    last_at = np.maximum.reduceat(us.fill_null(high).to_numpy(zero_copy_only=False), starts)
    first_value = np.minimum.reduceat(np.where(has, np.arange(n), n), starts)
    void = first_value >= ends
    at, last = np.where(void, starts, first_value), ends - 1
    take = lambda c: b.column(c).take(pa.array(starts))
    stamp = lambda x, none: pa.array(x, mask=x == none).cast(pa.timestamp("us"))
    columns = {
        "key_kind": take("key_kind"), "key_value": take("key_value"), "part": take("part"),
        "n_rows": pa.array(np.add.reduceat(count, starts)), "n_values": pa.array(np.add.reduceat(fresh.astype(np.int64), starts)),
        "first_h1": pa.array(h1[at], mask=void), "first_h2": pa.array(h2[at], mask=void),
        "last_h1": pa.array(h1[last], mask=void), "last_h2": pa.array(h2[last], mask=void),
        "first_at": stamp(first_at, low), "last_at": stamp(last_at, high),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def per_key(df: DataFrame, keys: dict[str, Column], row_id: Column, values: Column, at: Column, partitions: int | None = None) -> DataFrame:
    """``(key_kind, key_value, n_rows, n_values, first_at, last_at)`` per key.

    ``keys`` names the kinds of key and gives their columns, ``values`` is an
    array column whose distinct non-null elements are counted, ``at`` a time.
    Null keys form no group; null arrays and null elements hold no value; null
    times are ignored and give null where a key has no other. Values are told
    apart by 128 bits of two hashes. An empty table gives an empty result.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = F.array(*[F.struct(F.lit(k).alias("key_kind"), c.cast("string").alias("key_value")) for k, c in keys.items()])
    hashed = F.transform(
        F.array_distinct(F.filter(values, lambda v: v.isNotNull())),
        lambda v: F.named_struct(F.lit("h1"), F.xxhash64(v), F.lit("h2"), F.xxhash64(v, F.lit(1))),
    )
    # One row of a finding counts it (one = 1); the rows of its further values don't.
    rows = (
        df.select(F.explode(kinds).alias("k"), row_id.alias("id"), hashed.alias("vs"), at.alias("at"))
        .where("k.key_value is not null")
        .select("k.key_kind", "k.key_value", "id", "at", F.posexplode_outer("vs").alias("pos", "v"))
        .select("key_kind", "key_value", "v.h1", "v.h2", "id", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1).otherwise(0).cast("byte").alias("one"), "at")
    )
    order = ["key_kind", "key_value", "h1", "h2", "id"]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"))
    states = ranged.mapInArrow(_states, _STATE)
    # A value that ends a key's state in one partition and begins its state in a later one was counted twice.
    ordered = Window.partitionBy("key_kind", "key_value").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.max_by(F.struct("last_h1", "last_h2"), F.when(F.col("last_h1").isNotNull(), F.struct("last_h1", "last_h2"))).over(ordered)
    stitched = states.select("*", previous.alias("before"))
    twice = F.coalesce((F.col("before.last_h1") == F.col("first_h1")) & (F.col("before.last_h2") == F.col("first_h2")), F.lit(False))
    return stitched.groupBy("key_kind", "key_value").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.col("n_values") - twice.cast("long")).alias("n_values"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def heavy_keys(results: DataFrame, total: int, share: float) -> DataFrame:
    """The keys of ``results`` that at least ``share`` of all ``total`` rows have."""
    return results.where(F.col("n_rows") >= share * total - 1e-9)


def _findings_per_key(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "findings")
    values = F.transform("extracts", lambda x: x["value_text"])
    return f, per_key(f, {"template_id": F.col("template_id"), "file_path": F.col("file_path")}, F.col("finding_id"), values, F.col("found_at"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, results = _findings_per_key(spark, sf_dir)
    return heavy_keys(results, f.count(), 0.02).select("key_kind", "key_value")


def p3_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings_per_key(spark, sf_dir)[1]


P3_QUERIES = {"p3_found": p3_found, "p3_per_key": p3_per_key}

_KEYS = "(select 'template_id' as key_kind, template_id as key_value, * from findings union all select 'file_path', file_path, * from findings)"
P3_SQL = {
    "p3_found": f"""
        select key_kind, key_value from {_KEYS} where key_value is not null
        group by all having count(*) >= 0.02 * (select count(*) from findings)""",
    "p3_per_key": f"""
        with k as {_KEYS},
        r as (select key_kind, key_value, count(*) as n_rows, min(found_at) as first_at, max(found_at) as last_at
              from k where key_value is not null group by all),
        v as (select key_kind, key_value, count(distinct x.value_text) as n_values
              from (select key_kind, key_value, unnest(extracts) as x from k where key_value is not null) group by all)
        select r.key_kind, r.key_value, n_rows, coalesce(n_values, 0) as n_values, first_at, last_at
        from r left join v on r.key_kind = v.key_kind and r.key_value = v.key_value""",
}
