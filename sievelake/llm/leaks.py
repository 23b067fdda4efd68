"""Evaluation passages leaking into training documents.

All items are looked for in one pass over the documents. Texts become
sequences of word numbers; n-grams of words are the seeds. A bitmap of all
items' seeds, of bounded size, tells which stretches of which documents may
hold some; only these go on, as numbers, and are joined to the items by seeds
on the executors. Where only long runs are asked for, of every window of that
many words only the seed found in the fewest stretches is joined. Each pair is
aligned by Smith-Waterman, which scores edited copies, and gives the longest
run of equal words.

A word divided at a line end has two readings, joined and as its parts. Seeds
are taken from both, and a pair is aligned with the reading that its item
knows, so a pair's result depends on its two texts only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpointed, spread, table
from .batches import slices

#: Words of a seed, and equal consecutive words that make a leak.
SEED, RUN = 5, 12
#: Words of a seed of edited copies: a change in every fifth word leaves none of more.
EDITED_SEED = 4
#: Scores of a matrix row that are computed at once.
LOT = 1 << 16
#: Words of a document that are aligned at once, besides what may belong to an alignment on both sides.
STRETCH = 512
#: Most bits of the bitmap of seeds: 16 MB. What it lets through too many, the join drops.
FILTER_BITS = 27
MATCH, MISMATCH, GAP = 2, -1, -1

# Letters that have no canonical decomposition, by their plain spelling.
_PLAIN = {"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
_SPELLED = re.compile("[" + "".join(_PLAIN) + "]")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_HIDDEN = re.compile("[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
_SOFT = "\u00ad"
_BRACKETS = re.compile(r"\([^()\x1e]*\)|\[[^\[\]\x1e]*\]")
_DIVISION = re.compile("(?<=[^\\W_])[-\u2010\u2011\u00ad]+[ \t]*(?:\r\n|\n|\r|\u2028|\u2029)[ \t]*(?=[^\\W_])")
#: Separates the texts that are normalised together, and the parts of a divided word.
_STOP, _JOINT = "\x1e", "\x1f"
_OWN = str.maketrans({_STOP: " ", _JOINT: " "})
_WORD = re.compile(r"[^\W_]+(?:\x1f[^\W_]+)*|\x1e")


def _comparable(text: str) -> str:
    """Lower case, accents, hidden characters and interruptions resolved, divisions marked."""
    ascii_only = text.isascii()
    if not ascii_only:
        text = _HIDDEN.sub("", text)
    n = 1
    while n:  # brackets may be nested
        text, n = _BRACKETS.subn(" ", text)
    text = _DIVISION.sub(_JOINT, text)
    if ascii_only:
        return text.lower()
    return _SPELLED.sub(lambda m: _PLAIN[m[0]], _ACCENTS.sub("", unicodedata.normalize("NFKD", text.casefold()).replace(_SOFT, "")))


def words(text: str | None) -> list[str]:
    """The comparable words of a text, divided ones joined; null and blank texts have none."""
    return [w.replace(_JOINT, "") for w in _WORD.findall(_comparable((text or "").translate(_OWN)))]


@lru_cache(maxsize=1 << 18)
def number(word: str) -> int:
    """A number of 63 bits for a word, the same everywhere, never 0."""
    return (int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1) | 1


def align_all(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of word sequences its Smith-Waterman score and the longest run of equal words.

    Pairs of similar length form a lot; a row of all score matrices of a lot is
    computed at once, and a gap within a row is a running maximum. Words that
    fill a sequence up equal none, so they change neither result.
    """
    scores, longest = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    order = sorted(range(len(left)), key=lambda k: len(right[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (len(right[order[end]]) + 1) <= LOT:
            end += 1
        lot, at = order[at:end], end
        m = len(right[lot[-1]])
        a, b = np.full((len(lot), max(len(left[k]) for k in lot)), -1, np.int32), np.zeros((len(lot), m), np.int32)
        for i, k in enumerate(lot):
            a[i, : len(left[k])], b[i, : len(right[k])] = left[k], right[k]
        ramp = np.arange(m + 1, dtype=np.int32) * -GAP
        above, runs, now = (np.zeros((len(lot), m + 1), np.int32) for _ in range(3))
        for x in a.T:
            equal = b == x[:, None]
            row = above + GAP
            np.maximum(row[:, 1:], above[:, :-1] + (equal * np.int32(MATCH - MISMATCH) + np.int32(MISMATCH)), out=row[:, 1:])
            np.maximum(row, 0, out=row)
            row += ramp
            np.maximum.accumulate(row, axis=1, out=row)
            row -= ramp
            np.multiply(runs[:, :-1] + 1, equal, out=now[:, 1:])
            above, runs, now = row, now, runs
            scores[lot] = np.maximum(scores[lot], above.max(axis=1))
            longest[lot] = np.maximum(longest[lot], runs.max(axis=1))
    return scores, longest


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences and their longest run of equal words."""
    scores, longest = align_all([a], [b])
    return int(scores[0]), int(longest[0])


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """A number of 63 bits for each run of ``n`` words; 0 where one is unknown or too few are left."""
    m = len(s) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h, whole = np.zeros(m, np.uint64), np.ones(m, bool)
    for j in range(n):
        part = s[j : j + m]
        whole &= part > 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    out = (h >> np.uint64(1)).astype(np.int64) | 1
    out[~whole] = 0
    return out


class _Numbers(dict):
    """Numbers of the words of any item; 0 for other words, -1 for the end of a text."""

    def __missing__(self, word: str) -> int:
        return 0


class Encoder:
    """Texts as numbers of the items' words."""

    def __init__(self, vocabulary: list[str]):
        self.numbers = _Numbers({w: number(w) for w in vocabulary} | {_STOP: -1})

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
        """For each text its words, divided ones as their parts, and (place, parts, number if joined) of the divided ones."""
        text = _comparable("".join((t or "").translate(_OWN) + _STOP for t in texts))
        tokens = _WORD.findall(text)
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        split = [i for i, t in enumerate(tokens) if _JOINT in t] if _JOINT in text else []
        begin = k = 0
        for end in np.flatnonzero(ids < 0).tolist():
            at, begin = begin, end + 1
            out, divided, n = [], [], 0
            while k < len(split) and split[k] < end:
                parts = tokens[split[k]].split(_JOINT)
                out += [ids[at : split[k]], np.array([self.numbers[x] for x in parts], np.int64)]
                n += split[k] - at
                divided.append((n, len(parts), self.numbers["".join(parts)]))
                n += len(parts)
                at = split[k] + 1
                k += 1
            yield np.concatenate([*out, ids[at:end]]) if out else ids[at:end], divided


def reading(ids: np.ndarray, divided: list[tuple[int, int, int]], joins) -> tuple[np.ndarray, np.ndarray]:
    """A reading of a text and the places of its words: ``joins`` says of each divided word whether it is joined."""
    out, places, at = [], [], 0
    for k, (place, n, whole) in enumerate(divided):
        if joins(k, place, n, whole):
            out += [ids[at:place], [whole]]
            places += [np.arange(at, place), [place]]
            at = place + n
    out.append(ids[at:])
    places.append(np.arange(at, len(ids)))
    return np.concatenate(out).astype(np.int64), np.concatenate(places).astype(np.int64)


def readings(ids: np.ndarray, divided: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Readings that between them hold every reading of any two neighbouring divided words."""
    plain = ids, np.arange(len(ids))
    if not divided:
        return [plain]
    out = [plain, reading(ids, divided, lambda *_: True)]
    if len(divided) > 1:
        out += [reading(ids, divided, lambda k, *_, odd=odd: k % 2 == odd) for odd in (0, 1)]
    return out


def seeds_of(items: DataFrame, seed: int) -> DataFrame:
    """``(item_id, place, seed)`` of the items' n-grams."""
    schema = pa.schema([("item_id", pa.int64()), ("place", pa.int32()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, passage in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = grams(np.array([number(w) for w in words(passage)], np.int64), seed)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(g), pa.int64()), pa.array(range(len(g)), pa.int32()), pa.array(g)], schema=schema)

    return items.mapInArrow(run, "item_id long, place int, seed long")


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id, spelled, numbers)`` of the items' words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [words(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.list_(pa.string())), pa.array([[number(w) for w in t] for t in texts], pa.list_(pa.int64()))], names=["item_id", "spelled", "numbers"])

    return items.mapInArrow(run, "item_id long, spelled array<string>, numbers array<long>")


def bitmap(seeds: DataFrame) -> np.ndarray:
    """One flag per remainder of the seeds by the bitmap's size, built by the executors in buckets of 4 KB."""
    n = seeds.select("seed").distinct().count()
    bits = 1 << min(FILTER_BITS, max(15, (16 * n).bit_length()))
    at = F.pmod("seed", F.lit(bits)) + 1  # buckets begin with 1
    rows = seeds.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("flags")).collect()
    out = np.zeros(bits >> 3, np.uint8)
    for r in rows:
        out[(r.bucket - 1) << 12 : r.bucket << 12] = np.frombuffer(bytes(r.flags), np.uint8)
    return out


def _finder(vocabulary: list[str], flags: np.ndarray, seed: int, margin: int):
    """Stretches of (doc_id, text) rows that hold a seed of the bitmap."""
    joints = pa.list_(pa.struct([("place", pa.int32()), ("parts", pa.int32()), ("whole", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("stretch", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("joints", joints), ("seeds", pa.list_(pa.int64()))])
    mask = np.int64(len(flags) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        row = TaskContext.get().partitionId() << 36
        stretch = row
        for b in slices(batches, 1):
            out = []
            texts = list(encoder.encode(b.column(1).to_pylist()))
            # The plain readings of all texts are tested at once.
            begins = np.cumsum([0] + [len(ids) + 1 for ids, _ in texts])
            joined = np.zeros(begins[-1], np.int64)
            for s, (ids, _) in zip(begins, texts):
                joined[s : s + len(ids)] = ids
            g = grams(joined, seed)
            low = g & mask
            at = np.flatnonzero((g != 0) & (flags[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)) if len(g) else np.zeros(0, np.int64)
            owner = np.searchsorted(begins, at, side="right") - 1
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            for k, (doc, (ids, divided)) in enumerate(zip(b.column(0).to_pylist(), texts)):
                row += 1
                places, found = at[first[k] : first[k + 1]] - begins[k], g[at[first[k] : first[k + 1]]]
                for other, where in readings(ids, divided)[1:]:
                    h = grams(other, seed)
                    low = h & mask
                    hit = np.flatnonzero((h != 0) & (flags[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool))
                    places, found = np.concatenate([places, where[hit]]), np.concatenate([found, h[hit]])
                part = places // STRETCH
                for p in np.unique(part):
                    lo, hi = max(0, int(p) * STRETCH - margin), (int(p) + 1) * STRETCH + margin
                    stretch += 1
                    near = [(x - lo, n, whole) for x, n, whole in divided if lo <= x and x + n <= hi]
                    out.append((row, stretch, doc, ids[lo:hi], near, np.unique(found[part == p])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def _rarest(run: int, seed: int):
    """Of each window of ``run`` words of an item the seed that the fewest stretches hold.

    A window with a seed that occurs nowhere stands nowhere as a whole.
    """
    span = max(1, run - seed + 1)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n = pdf["n"].fillna(0).to_numpy(np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(n, min(span, len(n)))
        at = np.unique((np.arange(len(windows)) + windows.argmin(axis=1))[windows.min(axis=1) > 0])
        return pdf.iloc[at][["item_id", "seed"]].drop_duplicates()

    return keep


def _aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments of (row, doc_id, item_id, ids, joints, numbers) pairs."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int32()), ("longest_run", pa.int32()), ("item_words", pa.int32())])
    for b in batches:
        left, right = [], []
        for ids, joints, numbers in zip(b.column(3), b.column(4).to_pylist(), b.column(5)):
            ids, numbers = ids.values.to_numpy(), numbers.values.to_numpy()
            known = np.unique(numbers)
            if joints:
                mine = set(known.tolist())
                divided = [(j["place"], j["parts"], j["whole"]) for j in joints]
                ids, _ = reading(ids, divided, lambda k, at, n, whole, ids=ids, mine=mine: whole in mine or not all(int(x) in mine for x in ids[at : at + n]))
            left.append(np.searchsorted(known, numbers) + 1)
            slot = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            right.append(np.where(known[slot] == ids, slot + 1, 0))
        scores, longest = align_all(left, right)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(scores, pa.int32()), pa.array(longest, pa.int32()), pa.array([len(x) for x in left], pa.int32())], schema=schema)


def leaks(documents: DataFrame, items: DataFrame, seed: int = SEED, run: int = RUN, edited: bool = True) -> DataFrame:
    """``(doc_id, item_id, score, longest_run, item_words)`` of each document and passage that share a seed.

    ``documents`` needs doc_id and text, ``items`` item_id and passage. Every
    pair that shares ``seed`` equal consecutive words is among the rows,
    whatever else the two tables hold. Without ``edited`` only the pairs with
    ``run`` equal consecutive words are sure to be, and of those with fewer
    hardly any is aligned. The score is that of the best alignment within
    STRETCH words and three passages' lengths around a seed, which holds all
    that a seed's own alignment can reach. Null, blank and short texts share
    none; repeated rows repeat; empty tables give an empty result.

    What reaches the driver are the items' distinct words and the bitmap.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, score int, longest_run int, item_words int"
    asked = items.select("item_id", "passage").where("item_id is not null and passage is not null").dropDuplicates()
    told = checkpointed(item_words(asked))
    vocabulary = [r[0] for r in told.select(F.explode("spelled")).distinct().collect()]
    if not vocabulary:
        return spark.createDataFrame([], schema)
    longest = told.agg(F.max(F.size("numbers"))).collect()[0][0]
    seeds = checkpointed(seeds_of(asked, seed).where("seed <> 0"))
    docs = spread(documents.select("doc_id", "text").where("text is not null"), "doc_id")
    ddl = "row long, stretch long, doc_id long, ids array<long>, joints array<struct<place:int,parts:int,whole:long>>, seeds array<long>"
    hits = checkpointed(docs.mapInArrow(_finder(vocabulary, bitmap(seeds), seed, 3 * longest + seed), ddl))
    held = hits.select("stretch", F.explode("seeds").alias("seed"))
    if edited:
        kept = seeds.select("item_id", "seed").distinct()
    else:
        counts = held.groupBy("seed").agg(F.count("*").alias("n"))
        kept = seeds.join(counts, "seed", "left").groupBy("item_id").applyInPandas(_rarest(run, seed), "item_id long, seed long")
    pairs = held.join(kept, "seed").select("stretch", "item_id").distinct()
    texts = pairs.join(hits.select("row", "stretch", "doc_id", "ids", "joints"), "stretch").join(told.select("item_id", "numbers"), "item_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = texts.select("row", "doc_id", "item_id", "ids", "joints", "numbers", "stretch").repartition(tasks, "stretch").drop("stretch")
    aligned = both.mapInArrow(_aligner, "row long, doc_id long, item_id long, score int, longest_run int, item_words int")
    best = aligned.groupBy("row", "doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "longest_run", "item_words")])
    return best.select("doc_id", "item_id", "score", "longest_run", "item_words")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose alignment scores what a run of RUN words scores, held to such a run."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edited=False)
    return found.where((F.col("score") >= MATCH * RUN) & (F.col("longest_run") >= RUN)).select("doc_id", "item_id").distinct()


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which at least a fifth of the passage aligns, with their scores."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), seed=EDITED_SEED)
    return found.where(F.col("score") >= 0.2 * MATCH * F.col("item_words")).distinct()
