"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of a mix fixes how often each of its documents should be
taken, usually a fraction. Documents are rounded in pairs: size is moved at
random from one to the other until one is taken a whole number of times, so
the source's total size stays what it should be and every document keeps its
expectation. Each partition leaves one undecided document per mix and source;
those are paired again in a reduction tree, whose last one is drawn alone.
A source's size is therefore off by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import checkpointed, spread, table
from .subwords import MULTILINGUAL, encoder

#: Undecided documents combined by one node of the reduction tree.
FAN_IN = 64
_MASK = (1 << 64) - 1


def _draw(seed: int, *ids: int) -> float:
    """A number in [0, 1) that depends on its arguments only, so that a repeated task draws alike."""
    h = int(seed) & _MASK
    for i in ids:
        h = ((h ^ (int(i) & _MASK)) + 0x9E3779B97F4A7C15) & _MASK
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _MASK
        h ^= h >> 31
    return (h >> 11) / (1 << 53)


def pivot(a: tuple, b: tuple, seed: int) -> tuple[tuple | None, list[tuple[int, int, int]]]:
    """Moves size between two undecided documents until one is decided.

    A document is (doc_id, tokens, whole copies, probability of one more).
    Returns the one still undecided, if any, and the decided ones as (doc_id,
    tokens, copies).
    """
    (i, s, n, p), (j, t, m, q) = a, b
    x, y = p * s, q * t
    to_a, to_b = min(s - x, y), min(t - y, x)
    if _draw(seed, i, j) * (to_a + to_b) < to_b:
        x, y = x + to_a, y - to_a
    else:
        x, y = x - to_b, y + to_b
    left, done = None, []
    for d, size, whole, mass in ((i, s, n, x), (j, t, m, y)):
        if mass <= 1e-9 * size:
            done.append((d, size, whole))
        elif mass >= size * (1 - 1e-9):
            done.append((d, size, whole + 1))
        else:
            left = (d, size, whole, mass / size)
    return left, done


def count_tokens(documents: DataFrame, vocabulary: str = MULTILINGUAL) -> DataFrame:
    """``(doc_id, source_key, tokens)``; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source_key", "tokens"])

    docs = documents.select("doc_id", F.lower(F.trim("source")).alias("source_key"), "text")
    return spread(docs, "doc_id").mapInArrow(run, "doc_id long, source_key string, tokens long")


def plan(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of each mix should and can give.

    Columns: mix_id, source, source_key, target_share, target_tokens,
    available_tokens (times the cap) and rate (expected copies of each
    document, at most the cap). Null weights count as 0.
    """
    sizes = tokens.groupBy("source_key").agg(F.sum("tokens").alias("source_tokens"))
    total = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0))).collect()[0][0]
    mix = Window.partitionBy("mix_id")
    cap = F.coalesce("max_repeats", F.lit(1)).cast("long")
    t = (
        targets.where("mix_id is not null and source is not null")
        .select("mix_id", "source", F.lower(F.trim("source")).alias("source_key"), F.coalesce("weight", F.lit(0.0)).alias("weight"), cap.alias("cap"), "budget_ratio")
        .withColumn("target_share", F.coalesce(F.try_divide("weight", F.sum("weight").over(mix)), F.lit(0.0)))
        .join(sizes, "source_key", "left")
        .withColumn("target_tokens", F.col("target_share") * F.coalesce("budget_ratio", F.lit(0.0)) * F.lit(total))
        .withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumn("available_tokens", F.col("source_tokens") * F.col("cap"))
    )
    return t.select(
        "mix_id", "source", "source_key", "target_share", "target_tokens", "available_tokens",
        F.least(F.col("cap").cast("double"), F.coalesce(F.try_divide("target_tokens", "source_tokens"), F.lit(0.0))).alias("rate"),
    )


_ROUNDED = "mix_id int, source string, doc_id long, tokens long, copies long, p double, part long"


def _emit(rows: list[tuple], left: dict, part: int) -> pa.RecordBatch:
    rows = rows + [(*key, d, s, n, p, part) for key, (d, s, n, p) in left.items()]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    names = ["mix_id", "source", "doc_id", "tokens", "copies", "p", "part"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)


def _rounder(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[tuple, tuple] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            rows: list[tuple] = []
            for mix, source, doc, size, rate in zip(*(c.to_pylist() for c in b.columns)):
                whole = int(rate)
                p = rate - whole
                if size == 0 or p < 1e-12:
                    rows.append((mix, source, doc, size, whole, None, part))
                    continue
                key, mine = (mix, source), (doc, size, whole, p)
                other = left.pop(key, None)
                if other is None:
                    left[key] = mine
                    continue
                rest, done = pivot(other, mine, seed + mix)
                if rest:
                    left[key] = rest
                rows += [(mix, source, *d, None, part) for d in done]
            yield _emit(rows, {}, part)
        yield _emit([], left, part)

    return run


def _node(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, held = [], None
        for r in pdf.sort_values(["part", "doc_id"]).itertuples(index=False):
            mine = (int(r.doc_id), int(r.tokens), int(r.copies), float(r.p))
            if held is None:
                held = mine
                continue
            held, done = pivot(held, mine, seed + key[0])
            rows += [(key[0], key[1], *d, None, key[2]) for d in done]
        if held is not None:
            d, s, n, p = held
            if last:
                rows.append((key[0], key[1], d, s, n + (_draw(seed, key[0], d) < p), None, key[2]))
            else:
                rows.append((key[0], key[1], d, s, n, p, key[2]))
        return pd.DataFrame(rows, columns=["mix_id", "source", "doc_id", "tokens", "copies", "p", "part"])

    return run


def allocate(tokens: DataFrame, plans: DataFrame, seed: int = 11) -> DataFrame:
    """``(mix_id, source, doc_id, tokens, copies)`` of the documents taken at least once.

    ``plans`` is a small configuration table: its size is that of the mixes'
    definition. Documents without tokens are taken the whole part of their
    rate. A document appears once per mix and source.
    """
    rated = tokens.where("source_key is not null").join(F.broadcast(plans.where("rate > 0")), "source_key")
    first = checkpointed(rated.select("mix_id", "source", "doc_id", "tokens", "rate").mapInArrow(_rounder(seed), _ROUNDED))
    decided, open_ = first.where("p is null"), first.where("p is not null")
    nodes = (open_.agg(F.max("part").alias("m")).collect()[0].m or 0) + 1
    while True:
        nodes = -(-nodes // FAN_IN)
        level = open_.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("mix_id", "source", "part").applyInPandas(_node(seed, nodes == 1), _ROUNDED)
        if nodes == 1:
            decided = decided.unionByName(level)
            break
        level = checkpointed(level)
        decided, open_ = decided.unionByName(level.where("p is null")), level.where("p is not null")
    return decided.where("copies > 0").select("mix_id", "source", "doc_id", "tokens", "copies")


def report(plans: DataFrame, taken: DataFrame) -> DataFrame:
    """What was taken of each source of each mix, and whether it fell short.

    Columns: mix_id, source, target_share, target_tokens, available_tokens,
    n_documents and n_copies taken, actual_tokens, actual_share, short. A
    source is short if all that it may give was taken and its target isn't
    reached; one that could give more misses its target by less than a
    document, which rounding leaves open.
    """
    sums = [F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens")]
    out = plans.join(taken.groupBy("mix_id", "source").agg(*sums), ["mix_id", "source"], "left")
    for c in ("n_documents", "n_copies", "actual_tokens"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    share = F.try_divide("actual_tokens", F.sum("actual_tokens").over(Window.partitionBy("mix_id")))
    short = (F.col("actual_tokens") >= F.col("available_tokens")) & (F.col("actual_tokens") < F.col("target_tokens"))
    return out.select("mix_id", "source", "target_share", "target_tokens", "available_tokens", "n_documents", "n_copies", "actual_tokens", share.alias("actual_share"), short.alias("short"))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = MULTILINGUAL, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The documents of each mix with their copies, and the report of actual shares.

    Case and outer blanks of a document's source don't matter; documents with
    null source count only towards the total. A source without documents gives
    nothing and is short. Empty tables give empty results. Documents are
    tokenized once.
    """
    tokens = checkpointed(count_tokens(documents, vocabulary))
    plans = checkpointed(plan(tokens, targets))
    taken = allocate(tokens, plans, seed)
    return taken, report(plans, taken)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_inputs(spark, sf_dir))[1].where("short").select("mix_id", "source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_inputs(spark, sf_dir))[1]
