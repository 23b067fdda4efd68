"""Deduplicating new batches of findings against all history, incrementally.

The history is a table of all findings that arrived, each with the accepted
finding that stands for it. Its blocking key is the normalised template and
path, the block, together with a band of the number of characters: findings
that agree in four fifths of their characters are of one block and of equal or
neighbouring bands. A new batch

1. collapses findings equal after normalisation into classes;
2. probes the persisted keys with its own, and takes of the history only the
   accepted findings under them;
3. holds each new class against these, and then against the batch's other
   classes of the block, by the n-grams of its rarest characters that they
   share, a bound that no agreeing pair fails;
4. scores the pairs left field by field with weights that
   expectation-maximization learned from all comparisons so far, and takes a
   finding as a repeat if its weight reaches that of a match and an exact check
   of the agreeing characters confirms it;
5. unites each repeat with the first accepted finding it repeats, and appends
   the batch with these mappings. Earlier mappings never change.

The history is not moved for it: the classes of a batch of checked size are
sent to where the history is read. A larger batch, such as a first one, meets
the history by block instead, hot blocks cut into tiles.

A manifest per batch names the table's parts, so a history is reopened by its
path, and a batch that failed half-way leaves nothing behind. Parts of like
size are merged as they become many, and their buckets grow with them.
"""

from __future__ import annotations

import json
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import names_below, read_text, remove, scratch_path, table, write_text

#: Share of the characters that two findings' extracts must agree in.
AGREEMENT = 0.8
#: Characters of an n-gram: no shorter block of characters counts as agreeing.
GRAM = 3
#: Classes of a tile, accepted ones of a hot block's tile in multiples of it, and characters of the rows that a task compares at once.
TILE, KNOWN_TILES, LOT_CHARS = 4096, 2, 1 << 21
#: Share of a finding's characters whose n-grams are looked for.
PART = 0.4
#: Bits of an n-gram's number, the others hold its row; numbers whose occurrences are counted; pairs held at once.
KEY_BITS, RARITY, PAIRS = 40, 1 << 20, 1 << 20
#: Parts of one size of the history that are merged, and rows of a bucket.
FAN_IN, BUCKET_ROWS = 4, 1 << 16
#: New findings per task of the comparison.
TASK_ROWS = 1024
#: Most new findings of a batch, and characters of their values, that are sent to where the history is read.
SENT_ROWS, SENT_CHARS = 200_000, 32_000_000
#: Most new findings of a batch whose keys alone are sent there.
SENT_KEYS = 2_000_000


def block_columns() -> tuple[Column, Column]:
    """Template without case and outer blanks; path by its steps, null as a path of its own."""
    template = F.lower(F.regexp_replace("template_id", r"^\s+|\s+$", ""))
    steps = F.filter(F.split(F.regexp_replace("file_path", r"^\s+|\s+$", ""), r"[/\\]+"), lambda s: (s != "") & (s != "."))
    return template, F.coalesce(F.array_join(steps, "/"), F.lit("\x00"))


def normalised_values() -> Column:
    """The extract values without outer quotes, commas and blanks, in order; empty ones left out."""
    stripped = F.transform(F.col("extracts.value_text"), lambda x: F.regexp_replace(x, "^[\"'`,\\s]+|[\"'`,\\s]+$", ""))
    return F.array_sort(F.filter(F.coalesce(stripped, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")))


def band(total: Column) -> Column:
    """Number of a band of totals; totals within AGREEMENT of each other are in equal or neighbouring bands."""
    return F.floor(F.log(total + 1) / F.lit(math.log(1 / AGREEMENT))).cast("int")


def normalise(findings: DataFrame, *more: str) -> DataFrame:
    """``(finding_id, block, band, key, sig, total, spelled, vals)`` and further columns of findings with a template."""
    template, path = block_columns()
    return (
        findings.where("finding_id is not null and template_id is not null")
        .select("finding_id", F.xxhash64(template, path).alias("block"), F.xxhash64("template_id", "file_path").alias("spelled"), normalised_values().alias("vals"), *more)
        .withColumn("sig", F.xxhash64(F.array_join("vals", "\x00"), F.size("vals")))
        .withColumn("total", F.aggregate("vals", F.lit(0), lambda n, v: n + F.length(v)))
        .withColumn("band", band(F.col("total")))
        .withColumn("key", F.xxhash64("block", "band"))
    )


def probes(rows: DataFrame) -> DataFrame:
    """``(key)``: the distinct keys under which findings may lie that agree with one of ``rows``."""
    lo, hi = band(F.greatest(F.col("total") * AGREEMENT - 1e-6, F.lit(0.0))), band(F.col("total") / AGREEMENT + 1e-6)
    return rows.select("block", F.explode(F.sequence(lo, hi)).alias("band")).select(F.xxhash64("block", "band").alias("key")).distinct()


def agreement(a: list[str], b: list[str], least: float = 0.0) -> float:
    """Share of the longer side's characters that agree; equal values first, then the most alike.

    Two findings without values agree wholly. If the share can't reach
    ``least``, an upper bound below it may be given instead.
    """
    size = max(sum(map(len, a)), sum(map(len, b)))
    if not size:
        return 1.0
    x, y = Counter(a), Counter(b)
    same = x & y
    common = sum(len(v) * n for v, n in same.items())
    left, right = list((x - same).elements()), list((y - same).elements())
    if left and right:
        # Blocks that agree are of GRAM characters at least: m of them hold m / GRAM common n-grams or more.
        of_left, of_right = ([{v[i : i + GRAM] for i in range(len(v) - GRAM + 1)} for v in vs] for vs in (left, right))
        may = []
        for i, v in enumerate(left):
            for j, w in enumerate(right):
                # Each n-gram that is common may stand in the shorter value as often as it has room.
                shorter = min(len(v), len(w))
                if not of_left[i].isdisjoint(of_right[j]):
                    shared = sum(1 for k in range(shorter - GRAM + 1) if (v if len(v) == shorter else w)[k : k + GRAM] in (of_right[j] if len(v) == shorter else of_left[i]))
                    if 2 * GRAM * shared >= shorter:
                        may.append((i, j, min(GRAM * shared, shorter)))
        best: dict[int, int] = {}
        for i, _, n in may:
            best[i] = max(best.get(i, 0), n)
        bound = (common + sum(best.values())) / size
        if bound < least - 1e-9:
            return bound
        pairs = []
        for i, j, _ in may:
            v, w = left[i], right[j]
            n = sum(m.size for m in SequenceMatcher(None, v, w, autojunk=False).get_matching_blocks() if m.size >= GRAM)
            if 2 * n >= min(len(v), len(w)):
                pairs.append((-n, i, j))
        taken_left, taken_right = set(), set()
        for n, i, j in sorted(pairs):
            if i not in taken_left and j not in taken_right:
                taken_left.add(i)
                taken_right.add(j)
                common -= n
    return common / size


#: Lower edges of the agreement classes of a comparison pattern, and the outcomes of each field.
_CLASSES = [0.0, 0.3, 0.5, 0.65, AGREEMENT]
_SIZES = (len(_CLASSES), 3, 2)
#: What is known before any comparison: so many pairs of each pattern, which keep the weights of rare outcomes near even.
PRIOR_PAIRS = 2.0


def pattern(a: tuple, b: tuple, agreed: float) -> tuple[int, int, int]:
    """The comparison pattern of two findings: classes of agreement, of the ratio of their numbers of values, of their spelling."""
    n, m = len(a[3]), len(b[3])
    ratio = min(n, m) / max(n, m, 1)
    counts = 2 if n == m else 1 if ratio >= 0.5 else 0
    return sum(agreed >= e - 1e-9 for e in _CLASSES[1:]), counts, int(a[2] == b[2])


def learn_weights(patterns: Counter, rounds: int = 200) -> tuple[np.ndarray, float, float]:
    """Match weights (log likelihood ratios) of each field's outcomes, the log odds of a match before any field, and the least total of a match.

    ``patterns`` counts the pairs of each comparison pattern. Two-class
    expectation-maximization under independence of fields, until the weights
    stay the same; pairs that agree are matches throughout. Few pairs leave the
    weights near their start. The least total is 0, or what the weakest pattern
    of an agreeing pair has if that is less, so that no agreeing pair is lost.
    """
    p = np.array([(i, j, k) for i in range(_SIZES[0]) for j in range(_SIZES[1]) for k in range(_SIZES[2])])
    n = np.array([patterns.get(tuple(int(v) for v in x), 0) for x in p], float)
    agreeing = p[:, 0] >= _CLASSES.index(AGREEMENT)
    known = agreeing * 0.998 + 0.001
    match, weights, odds, total = known, np.zeros((3, max(_SIZES))), 0.0, known
    for _ in range(rounds):
        before = weights.copy()
        # The prior pairs keep their start: agreement alone tells them apart.
        yes, no = n * match + PRIOR_PAIRS * known, n * (1 - match) + PRIOR_PAIRS * (1 - known)
        odds = math.log(yes.sum() / no.sum())
        for f, size in enumerate(_SIZES):
            m, u = np.bincount(p[:, f], yes, minlength=size), np.bincount(p[:, f], no, minlength=size)
            weights[f, :size] = np.log(m / m.sum()) - np.log(u / u.sum())
        total = odds + sum(weights[f][p[:, f]] for f in range(3))
        match = np.where(agreeing, 1.0, 1 / (1 + np.exp(-np.clip(total, -50, 50))))
        if np.abs(weights - before).max() < 1e-9:
            break
    return weights, odds, min(0.0, float(total[agreeing].min()))


class Representatives:
    """Union-find over findings that are united in order of arrival, each with an accepted one.

    Accepted findings stand for themselves. What is kept are 16 bytes for each
    finding that repeats one, in order of its id.
    """

    def __init__(self):
        self.later, self.root = array("q"), array("q")

    def find(self, x: int) -> int:
        k = bisect_left(self.later, x)
        return self.root[k] if k < len(self.later) and self.later[k] == x else x

    def unite(self, later: int, earlier: int) -> None:
        """Puts ``later``, which is above all ids united before, under the representative of ``earlier``."""
        self.later.append(later)
        self.root.append(self.find(earlier))


class _Rows:
    """Rows that are compared, in columns: the group within which they are, total, id and values."""

    def __init__(self, group: np.ndarray, total: np.ndarray, ids: np.ndarray, vals: pa.Array):
        self.group, self.total, self.ids, self.vals = group, total.astype(np.int64), ids, vals


def _grams(vals: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters of lists of values, short values filled up to GRAM: row, number of the n-gram that begins there, whether one does, whether it is no filling.

    Numbers have KEY_BITS and are of an n-gram within its row's group.
    """
    flat = pc.cast(vals.flatten(), pa.string())
    real = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.utf8_rpad(flat, GRAM, "\x00")
    lengths = np.maximum(real, GRAM)
    row = np.repeat(np.repeat(np.arange(len(vals)), pc.list_value_length(vals).to_numpy(zero_copy_only=False).astype(np.int64)), lengths)
    if not len(row):
        none = np.zeros(0, bool)
        return row, np.zeros(0, np.uint64), none, none
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    text = flat.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode("utf-8", "surrogatepass")
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = p.copy()
    for k in range(1, GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h[:-k] += p[k:]
    h ^= group.astype(np.int64).view(np.uint64)[row]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    last = np.cumsum(lengths)
    begins, is_real = np.ones(len(p), bool), np.ones(len(p), bool)
    for k in range(1, GRAM):
        begins[last - k] = False
        is_real[(last - k)[real < GRAM - k + 1]] = False
    return row, h >> np.uint64(64 - KEY_BITS), begins, is_real


#: Powers of two by which n-grams are told to be rare, and the power of each small count.
_POWERS = 16
_POWER = np.minimum(np.ceil(np.log2(np.arange(1 << 14) + 1)), _POWERS - 2).astype(np.int8)


def _rarest(row: np.ndarray, rank: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Which elements are the ``take`` of their row with the lowest ranks below _POWERS, the first ones of equal rank; rows are in order."""
    n = np.bincount(row * _POWERS + rank, minlength=len(take) * _POWERS).reshape(-1, _POWERS)
    upto = np.cumsum(n, axis=1)
    # All of lower ranks than the edge, and of its rank what is left.
    edge = np.argmax(upto >= take[:, None], axis=1)
    left = take - (upto - n)[np.arange(len(take)), edge]
    level = edge.astype(np.int8)[row]
    at_edge = rank == level
    nth = np.cumsum(at_edge)
    start = np.searchsorted(row, np.arange(len(take)))
    before = np.concatenate([[0], nth])[start]
    return (rank < level) | at_edge & (nth <= (before + left)[row])


def near_pairs(fresh: _Rows, rows: _Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of ``fresh`` and of the earlier ``rows`` of their group that may agree with them.

    Of two findings that agree, all but (1 - AGREEMENT) of the longer one's
    characters lie in common blocks of GRAM characters or more. So do, of any
    part of a finding's characters, all but what it may have outside such
    blocks; each of these is in an n-gram that the other finding has as well,
    and an n-gram holds GRAM of them at most. The part taken are the PART
    characters whose n-grams are rarest among the rows. Numbers that clash only
    add to what is counted, so no pair that agrees is left out.
    """
    if not len(rows.ids) or not len(fresh.ids):
        return
    order = np.lexsort((rows.total, rows.group))
    group, total = rows.group[order], rows.total[order]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    groups, first = group[begin], np.minimum.reduceat(rows.ids[order], begin)
    place = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(group)))) << 32 | total
    at = np.minimum(np.searchsorted(groups, fresh.group), len(groups) - 1)
    lo = np.searchsorted(place, at << 32 | np.ceil(np.maximum(fresh.total * AGREEMENT - 1e-6, 0)).astype(np.int64))
    hi = np.searchsorted(place, at << 32 | np.floor(fresh.total / AGREEMENT + 1e-6).astype(np.int64), side="right")
    live = np.flatnonzero((groups[at] == fresh.group) & (first[at] < fresh.ids) & (lo < hi))
    if not len(live):
        return
    live = live[np.argsort(lo[live], kind="stable")]
    # Only rows that some new one may agree with by its total.
    step = np.zeros(len(order) + 1, np.int64)
    np.add.at(step, lo[live], 1)
    np.add.at(step, hi[live], -1)
    used = np.cumsum(step[:-1]) > 0
    new = np.concatenate([[0], np.cumsum(used)])
    lo, hi, order, total = new[lo], new[hi], order[used], total[used]
    ids = rows.ids[order]
    row, key, begins, _ = _grams(rows.vals.take(pa.array(order)), rows.group[order])
    posts = key[begins] << np.uint64(64 - KEY_BITS) | row[begins].astype(np.uint64)
    posts.sort()
    posts = posts[np.concatenate([[True], posts[1:] != posts[:-1]])] if len(posts) else posts
    common = np.bincount((posts >> np.uint64(64 - KEY_BITS) & np.uint64(RARITY - 1)).astype(np.int64), minlength=RARITY)
    # So many new rows at once that their pairs and characters stay few.
    cost = np.cumsum(hi[live] - lo[live] + fresh.total[live])
    for some in np.split(live, np.flatnonzero(np.diff(cost // PAIRS)) + 1):
        row, key, begins, is_real = _grams(fresh.vals.take(pa.array(some)), fresh.group[some])
        often = common[(key & np.uint64(RARITY - 1)).astype(np.int64)]
        # A character is as common as the most common n-gram around it; to the power of two that tells enough.
        held = np.where(begins, _POWER[np.minimum(often, len(_POWER) - 1)], 0).astype(np.int8)
        around = held.copy()
        for k in range(1, GRAM):
            np.maximum(around[k:], held[:-k], out=around[k:])
        around[~is_real] = _POWERS - 1
        picked = np.zeros(len(row) + GRAM, bool)
        take = np.minimum(np.ceil(fresh.total[some] * PART), fresh.total[some]).astype(np.int64)
        picked[: len(row)] = _rarest(row, around, take)
        asked = np.flatnonzero(begins & (often > 0) & np.any([picked[k : k + len(row)] for k in range(GRAM)], axis=0))
        asked = asked[np.argsort(key[asked])]
        of, number = row[asked], key[asked] << np.uint64(64 - KEY_BITS)
        s = np.searchsorted(posts, number | lo[some][of].astype(np.uint64))
        n = np.searchsorted(posts, number | hi[some][of].astype(np.uint64)) - s
        hit = n > 0
        of, s, n = of[hit], s[hit], n[hit]
        width = hi[some] - lo[some]
        base = np.cumsum(width) - width
        shared = np.zeros(int(width.sum()), np.int64)
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
            m = n[part]
            where = np.arange(m.sum()) + np.repeat(s[part] - np.cumsum(m) + m, m)
            to = (posts[where] & np.uint64((1 << 64 - KEY_BITS) - 1)).astype(np.int64) + np.repeat((base - lo[some])[of[part]], m)
            shared += np.bincount(to, minlength=len(shared))
        mine = fresh.total[some]
        may = np.flatnonzero(shared >= np.repeat((take - (1 - AGREEMENT) * mine) / GRAM - 1e-3, width))
        i = np.searchsorted(base, may, side="right") - 1
        j = may - (base - lo[some])[i]
        least = (take[i] - mine[i] + AGREEMENT * np.maximum(mine[i], total[j])) / GRAM
        ok = (shared[may] >= least - 1e-3) & (ids[j] < fresh.ids[some][i])
        if ok.any():
            yield some[i[ok]], order[j[ok]]


def alike(fresh: list[tuple], rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``fresh`` its index, and the indexes of the earlier ``rows`` that may agree with it; rows are (id, total, spelled, vals, ...)."""

    def columns(xs: list[tuple]) -> _Rows:
        return _Rows(np.zeros(len(xs), np.int64), np.array([x[1] for x in xs]), np.array([x[0] for x in xs], np.int64), pa.array([x[3] for x in xs], pa.list_(pa.string())))

    for i, j in near_pairs(columns(fresh), columns(rows)):
        for k in np.unique(i):
            yield int(k), j[i == k]


def _together(batches: Iterator[pa.RecordBatch], size: int, same: int = 0) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of some ``size`` characters by their column total; rows equal in the first ``same`` columns stay together."""
    held, chars = [], 0
    for b in batches:
        ends = np.cumsum(b.column("total").to_numpy(zero_copy_only=False)) // size
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            held.append(b.slice(lo, hi - lo))
            chars += pc.sum(held[-1].column("total")).as_py() or 0
            if chars < size:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            held, chars, go = [], 0, len(t)
            if same:
                other = np.any([_column(t, name) != t.column(name)[-1].as_py() for name in t.column_names[:same]], axis=0)
                go = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                held = t.slice(go).to_batches()
                chars = pc.sum(t.slice(go).column("total")).as_py() or 0
            if go:
                yield t.slice(0, go).combine_chunks()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _values(t: pa.Table) -> pa.Array:
    c = t.column("vals")
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _tuples(t: pa.Table, at: np.ndarray, *more: str) -> dict[int, tuple]:
    """The rows (id, total, spelled, vals, sig, ...) with some indexes."""
    at = np.unique(at)
    some = t.select([*_COMPARED, *more]).take(pa.array(at))
    return dict(zip(at.tolist(), zip(*(c.to_pylist() for c in some.columns))))


_LINKS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("f0", pa.int32()), ("f1", pa.int32()), ("f2", pa.int32()), ("n", pa.int64())])
_LINKS_DDL = "kind int, block long, a long, b long, f0 int, f1 int, f2 int, n long"
_REPEAT, _EDGE, _PATTERN = range(3)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LINKS.types)] if rows else [pa.array([], t) for t in _LINKS.types], schema=_LINKS)


class _Scorer:
    """The comparison of two findings by the learned weights, with the comparisons counted by pattern."""

    def __init__(self, weights: np.ndarray, odds: float, least: float):
        self.weights, self.odds, self.least, self.counted = weights, odds, least, Counter()

    def linked(self, a: tuple, b: tuple) -> bool:
        """Whether the weight speaks for a match of two rows (id, total, spelled, vals, sig, ...) and their agreement confirms it."""
        agreed = 1.0 if a[4] == b[4] else agreement(a[3], b[3], AGREEMENT)
        p = pattern(a, b, agreed)
        self.counted[p] += 1
        return self.odds + self.weights[0][p[0]] + self.weights[1][p[1]] + self.weights[2][p[2]] >= self.least - 1e-9 and agreed >= AGREEMENT - 1e-9

    def patterns(self) -> list[tuple]:
        return [(_PATTERN, None, None, None, *p, n) for p, n in self.counted.items()]


def _comparer(weights: np.ndarray, odds: float, least: float):
    """Links of tiles of (block, i, j, finding_id, total, spelled, vals, sig, fresh, part) rows, sorted by tile.

    A tile of a whole block is decided at once, in order of arrival. Tiles of
    parts of a hot block give pairs that agree; which of them count is decided
    when all are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(weights, odds, least)
        out: list[tuple] = []
        for t in _together(batches, LOT_CHARS, 3):
            block, i, j, ids, total, part = (_column(t, c) for c in ("block", "i", "j", "finding_id", "total", "part"))
            tile = np.cumsum(np.concatenate([[False], (np.diff(block) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            fresh, vals = _column(t, "fresh"), _values(t)
            # Where new rows meet a part of the accepted ones, they don't meet each other.
            new, old = np.flatnonzero(fresh), np.flatnonzero(~fresh | (j >= -1))
            some = (_Rows(tile[x], total[x], ids[x], vals.take(pa.array(x))) for x in (new, old))
            for b, a in _in_order(near_pairs(*some), tile[new], ids[new], ids[old]):
                b, a = new[b], old[a]
                # Two rows of one part meet in that part's own tile.
                apart = (i[b] == j[b]) | (part[a] != part[b])
                b, a = b[apart], a[apart]
                rows, reps, last, done = _tuples(t, np.concatenate([a, b]), "fresh"), Representatives(), -1, -1
                for y, x in zip(b.tolist(), a.tolist()):
                    if y == done:
                        continue
                    if tile[y] != last:
                        reps, last = Representatives(), tile[y]
                    whole, earlier, later = i[y] < 0, rows[x], rows[y]
                    if whole and reps.find(earlier[0]) != earlier[0] or not scorer.linked(earlier, later):
                        continue
                    if whole:
                        reps.unite(later[0], earlier[0])
                    out.append((_REPEAT if whole else _EDGE, int(block[y]), earlier[0], later[0], None, None, None, None))
                    if whole or not earlier[5]:
                        done = y  # accepted for sure, and the first such
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out + scorer.patterns())

    return run


def _in_order(pairs: Iterator[tuple[np.ndarray, np.ndarray]], group: np.ndarray, late: np.ndarray, early: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ``pairs`` at once, by the later one's group and id and then the earlier one's id."""
    found = list(pairs)
    if found:
        b, a = (np.concatenate(x) for x in zip(*found))
        at = np.lexsort((early[a], late[b], group[b]))
        yield b[at], a[at]


_held: dict[str, pa.Table] = {}


def _unpacked(sent, name: str) -> pa.Table:
    if name not in _held:
        _held.clear()
        _held[name] = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
    return _held[name]


def _some(sent, name: str, at: np.ndarray):
    """The rows with some indexes of a table that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _unpacked(sent, name).take(pa.array(at)).to_batches()

    return run


def _placer(later: np.ndarray, earlier: np.ndarray, step: int):
    """Rows of the history from those of a batch: ``later`` ones, in order, are represented by ``earlier`` ones, others by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep = ids = b.column("finding_id").to_numpy(zero_copy_only=False)
            if len(later):
                k = np.minimum(np.searchsorted(later, ids), len(later) - 1)
                rep = np.where(later[k] == ids, earlier[k], ids)
            vals = b.column("vals")
            kept = pc.if_else(pa.array(rep == ids), vals, pa.scalar(None, vals.type))  # only accepted ones are compared again
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], kept, pa.array(rep), pa.array(np.full(len(ids), step, np.int32))], names=[*b.schema.names, "rep", "step"])

    return run


def _prober(sent, name: str, weights: np.ndarray, odds: float, least: float):
    """Links to the accepted (block, finding_id, total, spelled, vals, sig) rows of the history, the first of each task for a new class.

    ``sent`` broadcasts the new classes as such rows, and ``name`` tells them
    from others: a worker unpacks them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _unpacked(sent, name)
        block, ids = _column(new, "block"), _column(new, "finding_id")
        fresh = _Rows(block, _column(new, "total"), ids, _values(new))
        scorer, first, block_of = _Scorer(weights, odds, least), {}, {}
        for t in _together(batches, LOT_CHARS):
            known = _column(t, "finding_id")
            for b, a in _in_order(near_pairs(fresh, _Rows(_column(t, "block"), _column(t, "total"), known, _values(t))), block, ids, known):
                later, earlier = _tuples(new, b), _tuples(t, a)
                for y, x in zip(b.tolist(), a.tolist()):
                    if earlier[x][0] < first.get(later[y][0], earlier[x][0] + 1) and scorer.linked(earlier[x], later[y]):
                        first[later[y][0]], block_of[later[y][0]] = earlier[x][0], int(block[y])
        yield _batch([(_REPEAT, block_of[x], a, x, None, None, None, None) for x, a in first.items()] + scorer.patterns())

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (block, b, a) edges in this order: the findings that repeat an accepted one, with the first such."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for _, group in groupby(rows, key=lambda r: r[0]):
        reps, out = Representatives(), []
        for b, edges in groupby(group, key=lambda r: r[1]):
            a = next((e[2] for e in edges if reps.find(e[2]) == e[2]), None)
            if a is not None:
                reps.unite(b, a)
                out.append((a, b))
        for at in range(0, len(out), 10_000):
            a, b = zip(*out[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _settled(links: DataFrame, tasks: int) -> DataFrame:
    """``(a, b)`` of the findings that repeat an accepted one by the edges among ``links``."""
    edges = links.where(F.col("kind") == _EDGE).select("block", "b", "a").distinct()
    return edges.repartition(tasks, "block").sortWithinPartitions("block", "b", "a").mapInArrow(_settle, "a long, b long")


def tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """``rows`` with the tiles they are compared in.

    A block of up to ``tile`` rows is one tile, numbered -1. Of a hot block,
    the new rows are cut into parts of their bands, and each part is held
    against the parts of its own and of the neighbouring bands only, every two
    in a tile of their own. The accepted rows are cut into parts of their bands
    as well, and each lies in one tile with the new rows of these bands, or in
    as many as the new rows need: what is copied are the new rows, not the
    history. Numbers ``j`` below -1 tell such tiles.
    """
    sizes = rows.groupBy("block", "band").agg(F.count_if("fresh").alias("new"), F.count_if(~F.col("fresh")).alias("known"))
    per_band = lambda n: F.map_from_entries(F.collect_list(F.struct("band", n)))
    parts_of = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    hot = (
        sizes.groupBy("block")
        .agg(F.sum(F.col("new") + F.col("known")).alias("n"), per_band(F.col("new")).alias("new"), per_band(parts_of("new", tile)).alias("parts"), per_band(parts_of("known", KNOWN_TILES * tile)).alias("held"))  # bands are few: the logarithm of the largest total
        .where(F.col("n") > tile)
        .drop("n")
    )
    band, number = F.col("band"), lambda b, k: b.cast("long") * (1 << 32) + k
    of = lambda c, b: F.coalesce(F.element_at(c, b), F.lit(0))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    pair = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    near = F.sequence(band - 1, band + 1)
    # So many pieces of the new rows meet a part of the accepted ones of a band.
    pieces = lambda b: F.ceil((of("new", b - 1) + of("new", b) + of("new", b + 1)) / tile).cast("int")
    piece = lambda k: F.lit(-2) - k
    nth = lambda n: F.pmod(F.xxhash64("finding_id"), F.greatest(n, F.lit(1)))
    cut = rows.join(F.broadcast(hot), "block", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(-1)).when(F.col("fresh"), number(band, nth(of("parts", band)))).otherwise(F.lit(-2)))
    part = F.col("part")
    among_new = F.flatten(F.transform(near, lambda b: upto(of("parts", b), lambda k: pair(F.least(part, number(b, k)), F.greatest(part, number(b, k))))))
    with_known = F.flatten(F.transform(near, lambda b: upto(of("held", b), lambda k: pair(number(b, k), piece(nth(pieces(b)))))))
    known = upto(pieces(band), lambda k: pair(number(band, nth(of("held", band))), piece(k)))
    tiled = F.when(F.col("parts").isNull(), F.array(pair(F.lit(-1), F.lit(-1)))).when(F.col("fresh"), F.concat(among_new, with_known)).otherwise(known)
    return cut.withColumn("at", F.explode(tiled)).select("block", "at.i", "at.j", "finding_id", "total", "spelled", "vals", "sig", "fresh", "part")


def _uncut(rows: DataFrame) -> DataFrame:
    """``rows`` with each block as one tile."""
    one = F.lit(-1).cast("long")
    return rows.select("block", one.alias("i"), one.alias("j"), "finding_id", "total", "spelled", "vals", "sig", "fresh", one.alias("part"))


_COMPARED = ["finding_id", "total", "spelled", "vals", "sig"]
_ROW = "finding_id long, block long, band int, key long, sig long, total int, spelled long, vals array<string>, rep long, step int, bucket int"


class History:
    """All findings that arrived, and the accepted one that stands for each.

    It lies below ``path``, in the shared folder where none is given, and a new
    object with that path goes on where the last one ended. One process writes
    at a time; ``tile`` is the most classes of a block that are compared in one
    task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, tile: int = TILE):
        self.spark, self.path, self.tile = spark, path or scratch_path(spark, "history"), tile
        manifests = [n for n in names_below(spark, f"{self.path}/manifests") if n.endswith(".json")]
        known = json.loads(read_text(spark, f"{self.path}/manifests/{manifests[-1]}")) if manifests else {}
        self.step: int = known.get("step", 0)
        self.last_id: int | None = known.get("last_id")
        self.segments: list[dict] = known.get("segments", [])
        self.replaced: list[str] = known.get("replaced", [])
        self.patterns = Counter({tuple(p): n for p, n in known.get("patterns", [])})

    def _commit(self, replaced: list[str]) -> None:
        stale, self.replaced = self.replaced, replaced
        patterns = [[list(map(int, p)), int(n)] for p, n in sorted(self.patterns.items())]
        text = json.dumps({"step": self.step, "last_id": self.last_id, "segments": self.segments, "replaced": replaced, "patterns": patterns})
        write_text(self.spark, f"{self.path}/manifests/{self.step:08d}.json", text)
        # What the manifest before named last may still be read by whoever got it; what was replaced then is not.
        remove(self.spark, *[f"{self.path}/segments/{x}" for x in stale])

    def _read(self, segments: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """Rows of segments, of all or of the given hash buckets only."""
        out = self.spark.createDataFrame([], _ROW) if not segments else None
        for s in segments:
            part = self.spark.read.schema(_ROW).parquet(f"{self.path}/segments/{s['name']}")
            if buckets is not None and s["buckets"] > 1:
                part = part.where(F.col("bucket").isin(sorted({b % s["buckets"] for b in buckets})))
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, rows: DataFrame, name: str, level: int, n: int) -> dict:
        buckets = 1 << max(0, math.ceil(n / BUCKET_ROWS) - 1).bit_length()
        placed = rows.withColumn("bucket", F.pmod("block", F.lit(buckets)).cast("int"))
        placed = (placed.repartition(buckets, "bucket") if buckets > 1 else placed.coalesce(1)).sortWithinPartitions("bucket", "key")
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/segments/{name}")
        return {"name": name, "level": level, "rows": n, "buckets": buckets}

    def repeats(self) -> DataFrame:
        """``(finding_id_a, finding_id_b)``: b repeats the accepted finding a."""
        return self._read(self.segments).where("rep <> finding_id").select(F.col("rep").alias("finding_id_a"), F.col("finding_id").alias("finding_id_b"))

    def _tasks(self, n: int) -> int:
        return max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), n // TASK_ROWS))

    def _link_sent(self, batch: DataFrame, n: int, found: str) -> tuple[DataFrame, Counter]:
        """The rows of a small batch with what stands for each, and the comparisons by pattern: its classes go to where the history is read."""
        spark, model = self.spark, learn_weights(self.patterns)
        t = batch.select("block", "band", *_COMPARED).toArrow().combine_chunks()
        block, sig, ids = (_column(t, c) for c in ("block", "sig", "finding_id"))
        order = np.lexsort((ids, sig, block))
        begins = np.concatenate([[True], (block[order][1:] != block[order][:-1]) | (sig[order][1:] != sig[order][:-1])])
        rep, new = np.empty(n, np.int64), order[begins]
        rep[order] = ids[new][np.cumsum(begins) - 1]
        links, patterns = np.zeros((0, 2), np.int64), Counter()

        def told(found: DataFrame) -> np.ndarray:
            """The (b, a) links, with the patterns counted."""
            out = found.toArrow().to_pylist()
            for r in out:
                if r["kind"] == _PATTERN:
                    patterns[r["f0"], r["f1"], r["f2"]] += r["n"]
            return np.array(sorted((r["b"], r["a"]) for r in out if r["kind"] == _REPEAT), np.int64).reshape(-1, 2)

        fresh, sink = t.take(pa.array(new)), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, fresh.schema) as w:
            w.write_table(fresh)
        everywhere = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        if self.segments:
            total = _column(fresh, "total").astype(float)
            lo, hi = (np.floor(np.log(x + 1) / math.log(1 / AGREEMENT)).astype(np.int64) for x in (np.maximum(total * AGREEMENT - 1e-6, 0), total / AGREEMENT + 1e-6))
            bands = np.repeat(lo - np.cumsum(hi - lo + 1) + (hi - lo + 1), hi - lo + 1) + np.arange((hi - lo + 1).sum())
            keys = pa.table({"block": np.repeat(block[new], hi - lo + 1), "band": pa.array(bands, pa.int32())}).group_by(["block", "band"]).aggregate([])
            widest = max(s["buckets"] for s in self.segments)
            accepted = self._read(self.segments, np.unique(block[new] % widest).tolist()).where("rep = finding_id")
            accepted = accepted.join(F.broadcast(spark.createDataFrame(keys).select(F.xxhash64("block", "band").alias("key"))), "key", "left_semi")
            probed = accepted.select("block", *_COMPARED).mapInArrow(_prober(everywhere, found, *model), _LINKS_DDL)
            # At most one row for each new finding and for each pattern.
            links = told(probed.groupBy("kind", "b", "f0", "f1", "f2").agg(F.min("a").alias("a"), F.sum("n").alias("n")))
        # What is left meets within its block.
        held = np.flatnonzero(~np.isin(ids[new], links[:, 0]))
        _, at, counts = np.unique(block[new][held], return_inverse=True, return_counts=True)
        held = held[counts[at] > 1]
        if len(held):
            rows = spark.range(0, 1, 1, 1).mapInArrow(_some(everywhere, found, held), batch.select("block", "band", *_COMPARED).schema).withColumn("fresh", F.lit(True))
            hot, tasks = counts.max() > self.tile, self._tasks(len(held))
            compared = (tiles(rows, self.tile) if hot else _uncut(rows)).repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j")
            compared = compared.mapInArrow(_comparer(*model), _LINKS_DDL)
            if hot:
                compared.write.parquet(f"{found}/new")
                compared = spark.read.schema(_LINKS_DDL).parquet(f"{found}/new")
                edges = _settled(compared, tasks).toArrow()
                links = np.concatenate([links, np.stack([_column(edges, "b"), _column(edges, "a")], axis=1)])
                compared = compared.where(F.col("kind") != _EDGE)
            links = np.concatenate([links, told(compared)])
        everywhere.destroy()
        # A class that repeats an accepted finding is represented by it.
        links = links[np.argsort(links[:, 0])]
        if len(links):
            k = np.minimum(np.searchsorted(links[:, 0], rep), len(links) - 1)
            rep = np.where(links[k, 0] == rep, links[k, 1], rep)
        moved = np.flatnonzero(rep != ids)
        moved = moved[np.argsort(ids[moved])]
        columns = ["finding_id", "block", "band", "key", "sig", "total", "spelled", "vals"]
        return batch.select(columns).mapInArrow(_placer(ids[moved], rep[moved], self.step), _ROW.removesuffix(", bucket int")), patterns

    def _link_by_block(self, batch: DataFrame, n: int, found: str) -> tuple[DataFrame, Counter]:
        """The same for a batch of any size, which meets the history by block."""
        spark, tasks = self.spark, self._tasks(n)
        classes = batch.groupBy("block", "sig").agg(F.min("finding_id").alias("first"))
        batch.join(classes, ["block", "sig"]).write.parquet(f"{found}/classed")
        batch = spark.read.parquet(f"{found}/classed")
        fresh = batch.where("finding_id = first")
        held = fresh.select("block", "band", *_COMPARED, F.lit(True).alias("fresh"))
        if self.segments:
            widest = max(s["buckets"] for s in self.segments)
            touched = [r[0] for r in fresh.select(F.pmod("block", F.lit(widest))).distinct().collect()]
            keys = probes(fresh)
            accepted = self._read(self.segments, touched).where("rep = finding_id").join(F.broadcast(keys) if n <= SENT_KEYS else keys, "key", "left_semi")
            # The history is read once: the rows under these keys are those that are cut into tiles.
            held.unionByName(accepted.select("block", "band", *_COMPARED, F.lit(False).alias("fresh"))).write.parquet(f"{found}/held")
            held = spark.read.parquet(f"{found}/held")
        compared = tiles(held, self.tile).repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j")
        compared.mapInArrow(_comparer(*learn_weights(self.patterns)), _LINKS_DDL).write.parquet(f"{found}/new")
        links = spark.read.schema(_LINKS_DDL).parquet(f"{found}/new")
        # At most one row per pattern, and one for all edges.
        told = links.where(F.col("kind") != _REPEAT).groupBy("kind", "f0", "f1", "f2").agg(F.sum("n").alias("n")).collect()
        united = links.where(F.col("kind") == _REPEAT).groupBy("b").agg(F.min("a").alias("a"))
        if any(r.kind == _EDGE for r in told):
            united = united.select("a", "b").unionByName(_settled(links, tasks))
        mapped = batch.join(united, F.col("first") == F.col("b"), "left").withColumn("rep", F.coalesce("a", "first"))
        kept = F.when(F.col("rep") == F.col("finding_id"), F.col("vals"))  # only accepted ones are compared again
        mapped = mapped.select("finding_id", "block", "band", "key", "sig", "total", "spelled", kept.alias("vals"), "rep", F.lit(self.step).alias("step"))
        return mapped, Counter({(r.f0, r.f1, r.f2): r.n for r in told if r.kind == _PATTERN})

    def add(self, findings: DataFrame) -> DataFrame:
        """Takes one new batch in and returns ``(finding_id_a, finding_id_b)`` of those that repeat an accepted one.

        Findings without template are not taken in. Null and empty extracts
        are alike, null elements count as none, further columns are ignored and
        an empty batch changes nothing. Ids grow from batch to batch; a batch
        with an id not above all earlier ones is refused. The returned frame
        is to be read before the call after the next.
        """
        staged = scratch_path(self.spark, "batch")
        normalise(findings).write.parquet(staged)
        return self._take(staged)

    def _take(self, staged: str) -> DataFrame:
        """``add`` of the normalised findings in a folder, which is deleted."""
        spark, step = self.spark, self.step
        found = scratch_path(spark, "links")
        batch = spark.read.parquet(staged)
        n, first, last, chars = batch.agg(F.count("*"), F.min("finding_id"), F.max("finding_id"), F.sum("total")).collect()[0]
        if not n or self.last_id is not None and first <= self.last_id:
            remove(spark, staged)
            if not n:
                return self.repeats().limit(0)
            raise ValueError(f"finding {first} is not above {self.last_id}, the last one taken in")
        link = self._link_sent if n <= SENT_ROWS and chars <= SENT_CHARS else self._link_by_block
        mapped, patterns = link(batch, n, found)
        segments, replaced = [*self.segments, self._write(mapped, f"{step:08d}-0", 0, n)], []
        while len(same := [s for s in segments if s["level"] == segments[-1]["level"]]) >= FAN_IN:
            level = same[0]["level"] + 1
            merged = self._write(self._read(same).drop("bucket"), f"{step:08d}-{level}", level, sum(s["rows"] for s in same))
            segments = [s for s in segments if s not in same] + [merged]
            replaced += [s["name"] for s in same]
        self.patterns.update(patterns)
        self.segments, self.step, self.last_id = segments, step + 1, last
        self._commit(replaced)
        remove(spark, staged, found)
        now = self._read([segments[-1]]).where(F.col("step") == step)
        return now.where("rep <> finding_id").select(F.col("rep").alias("finding_id_a"), F.col("finding_id").alias("finding_id_b"))


def replay(findings: DataFrame, path: str | None = None) -> History:
    """The history of ``findings``, its batches taken in one by one in order of batch_no, null as the first."""
    spark = findings.sparkSession
    history, staged = History(spark, path), scratch_path(spark, "arrivals")
    normalise(findings, "batch_no").write.option("compression", "zstd").partitionBy("batch_no").parquet(staged)
    batches = [x for x in names_below(spark, staged) if "=" in x]
    for name in sorted(batches, key=lambda x: int(x.split("=")[1]) if x.split("=")[1].lstrip("-").isdigit() else -math.inf):
        history._take(f"{staged}/{name}")
    remove(spark, staged)
    return history


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(table(spark, sf_dir, "findings")).repeats()
