"""Cutting oversized payloads into overlapping pieces at natural boundaries.

For a payload longer than its limit the least number of pieces is computed and
equally spaced targets are placed. Each target snaps to the strongest boundary
near it, or else to the nearest one that keeps all limits. Only where a piece
reaches none at all is it cut at its target, then never inside a UTF-8
character; the targets around such a bare stretch are served as any other. If
a limit fails, more pieces are placed until none does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import spread, table

#: Defaults of a writer that sets none, in bytes.
WINDOW, OVERLAP = 32768, 512


def boundaries(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the natural boundaries inside ``data`` and their strengths.

    A boundary lies after each line end (LF, CR LF or CR alone, strength 1; 2
    after a blank line) and after each run of NUL bytes (strength 3).
    """
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    following = np.append(b[1:], 1)
    lf = b == 10
    end = lf | (b == 13) & (following != 10)
    nul = (b == 0) & (following != 0)
    at = np.flatnonzero(end | nul) + 1
    strength = np.where(nul[at - 1], 3, 1).astype(np.int8)
    # A line end right after another one closes a blank line.
    previous = np.concatenate([[-9], at[:-1]])
    width = np.where(lf[at - 1] & (at >= 2) & (b[np.maximum(at - 2, 0)] == 13), 2, 1)
    strength[(strength == 1) & (at - width == previous)] = 2
    keep = at < len(b)
    return at[keep], strength[keep]


def _aside(data, position: int, lowest: int) -> int:
    """``position``, or up to three bytes before it if it would divide a UTF-8 character."""
    at = position
    while at > max(lowest, position - 3) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at if data[at] & 0xC0 != 0x80 else position


def _place(data, at: np.ndarray, strength: np.ndarray, window: int, overlap: int, n: int) -> tuple[list[int], list[bool]] | None:
    """Ends of at most ``n`` pieces near equal targets and whether they are natural, or None if a limit fails."""
    length = len(data)
    step = (length - overlap) / n
    ends: list[int] = []
    natural: list[bool] = []
    last = 0
    for i in range(1, n + 1):
        start = max(last - overlap, 0)
        if length - start <= window:
            return [*ends, length], [*natural, True]
        target, top = overlap + i * step, start + window
        # Nothing before ``low`` lets the pieces that are left reach the end.
        low = max(last + 1, length - (n - i) * (window - overlap))
        if low > top:
            return None
        first, lo, hi = np.searchsorted(at, last, side="right"), np.searchsorted(at, low), np.searchsorted(at, top, side="right")
        if lo < hi:
            close = slice(max(lo, np.searchsorted(at, target - step / 2)), min(hi, np.searchsorted(at, target + step / 2, side="right")))
            near, power = at[close], strength[close]
            if not len(near):
                near, power = at[lo:hi], np.zeros(hi - lo)
            # The strongest within reach; among equals, or beyond it, the nearest.
            last = int(near[np.lexsort((np.abs(near - target), -power))[0]])
            natural.append(True)
        elif first < lo:
            return None  # there is a boundary, but so few pieces can't use it
        else:
            last = _aside(data, int(min(max(target, low), top)), last + 1)
            if last < low:
                return None  # so few pieces leave no room to keep the character whole
            natural.append(False)
        ends.append(last)
    return None


def cut(data: bytes | memoryview, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts, ends and naturalness of the pieces of ``data``, and the longest stretch without boundary that had to be cut.

    An empty payload has no piece, one within the limit a single piece. An
    overlap not smaller than the window counts as none. The stretch is 0 if all
    cuts are natural; a stretch longer than the window always holds a cut.
    """
    length = len(data)
    window = max(1, window)
    overlap = overlap if 0 <= overlap < window else 0
    if not length:
        return *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool), 0
    if length <= window:
        return np.zeros(1, np.int64), np.array([length]), np.ones(1, bool), 0
    at, strength = boundaries(data)
    n, placed = -(-(length - overlap) // (window - overlap)), None
    tries = 0
    while placed is None:
        placed = _place(data, at, strength, window, overlap, n)
        tries += 1
        n += max(1, n * tries // 64)  # one more, later some more at once
    ends, natural = np.array(placed[0], np.int64), np.array(placed[1])
    starts = np.concatenate([[0], np.maximum(ends[:-1] - overlap, 0)])
    edges = np.concatenate([[0], at, [length]])
    bare = np.searchsorted(edges, ends[~natural])
    return starts, ends, natural, int((edges[bare] - edges[bare - 1]).max()) if len(bare) else 0


def _limits(blocks: DataFrame, writers: DataFrame) -> DataFrame:
    """``blocks`` with their writer's limits; the writers' table is small and fixed."""
    w = writers.groupBy("writer_id").agg(F.min("window_size").alias("window_size"), F.min("overlap_size").alias("overlap_size"))
    return (
        blocks.select("block_id", "run_id", "writer_id", "base_address", "payload")
        .join(w, "writer_id", "left")
        .select(
            "block_id", "run_id", F.coalesce("base_address", F.lit(0)).alias("base_address"), "payload",
            F.coalesce("window_size", F.lit(WINDOW)).alias("window_size"), F.coalesce("overlap_size", F.lit(OVERLAP)).alias("overlap_size"),
        )
    )


def pieces(blocks: DataFrame, writers: DataFrame, content: bool = True) -> DataFrame:
    """The pieces of every payload, in order, each starting ``overlap_size`` bytes before the last one's end.

    Columns: block_id, run_id, piece_no (from 1), start_offset, end_offset,
    address, at_boundary, and with ``content`` the bytes. Null and empty
    payloads have no piece, those within the limit one. A missing writer counts
    as one without settings. Each payload is cut within its own row: no shuffle.
    """
    fields = [("block_id", pa.int64()), ("run_id", pa.int64()), ("piece_no", pa.int32()), ("start_offset", pa.int64()), ("end_offset", pa.int64()), ("address", pa.int64()), ("at_boundary", pa.bool_())]
    schema = pa.schema(fields + [("content", pa.binary())] * content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names if c != "payload"}
            for i, payload in enumerate(b.column("payload")):
                if not payload.is_valid:
                    continue
                data = memoryview(payload.as_buffer())
                s, e, natural, _ = cut(data, cols["window_size"][i], cols["overlap_size"][i])
                n = len(s)
                if not n:
                    continue
                same = lambda v: pa.array([v] * n, pa.int64())
                out = [same(cols["block_id"][i]), same(cols["run_id"][i]), pa.array(range(1, n + 1), pa.int32()), pa.array(s), pa.array(e), pa.array(s + cols["base_address"][i]), pa.array(natural)]
                if content:
                    out.append(pa.array([bytes(data[x:y]) for x, y in zip(s, e)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    ddl = "block_id long, run_id long, piece_no int, start_offset long, end_offset long, address long, at_boundary boolean" + ", content binary" * content
    return _limits(spread(blocks, "block_id"), writers).mapInArrow(run, ddl)


def block_report(blocks: DataFrame, writers: DataFrame) -> DataFrame:
    """``(block_id, run_id, n_bytes, n_pieces, n_forced, longest_forced, uncuttable)`` per block.

    ``n_forced`` counts the pieces that could not be placed at a boundary,
    ``longest_forced`` is the longest bare stretch among those they cut, and
    ``uncuttable`` says whether it is longer than the window; a shorter one is
    cut where the overlap takes up the room that was left. Null payloads count
    0 bytes and pieces.
    """
    schema = pa.schema([("block_id", pa.int64()), ("run_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("n_forced", pa.int64()), ("longest_forced", pa.int64()), ("uncuttable", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, runs, window, overlap = (b.column(c).to_pylist() for c in ("block_id", "run_id", "window_size", "overlap_size"))
            rows = []
            for i, payload in enumerate(b.column("payload")):
                data = memoryview(payload.as_buffer()) if payload.is_valid else b""
                s, _, natural, stretch = cut(data, window[i], overlap[i])
                rows.append((ids[i], runs[i], len(data), len(s), int((~natural).sum()), stretch, stretch > window[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    ddl = "block_id long, run_id long, n_bytes long, n_pieces long, n_forced long, longest_forced long, uncuttable boolean"
    return _limits(spread(blocks, "block_id"), writers).mapInArrow(run, ddl)


def regions(blocks: DataFrame, writers: DataFrame, stats: DataFrame) -> DataFrame:
    """``stats``, one row per run, with n_regions set to the run's number of pieces.

    Statistics delivered twice count once; a run without blocks has 0.
    """
    n = block_report(blocks, writers).groupBy("run_id").agg(F.sum("n_pieces").alias("n_pieces"))
    return stats.distinct().join(n, "run_id", "left").withColumn("n_regions", F.coalesce("n_pieces", F.lit(0))).select(*stats.columns)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "blocks"), table(spark, sf_dir, "block_writers")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_report(*_inputs(spark, sf_dir)).where("uncuttable").select("block_id")


def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(*_inputs(spark, sf_dir), table(spark, sf_dir, "scan_stats")).select("run_id", "n_files", "n_regions", "n_bytes")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(*_inputs(spark, sf_dir), content=False)


# A payload as its bytes' hexadecimal digits with a blank behind each; a stretch runs to the end of a line or of a run of NUL bytes.
_OTHER = "(?:[1-9A-F][0-9A-F]|0[1-9BCEF]) "
_STRETCH = f"(?:{_OTHER})*(?:0D 0A |0A |0D |(?:00 )+)|(?:{_OTHER})+"
SQL = {
    "p4_found": f"""
        with w as (select writer_id, min(window_size) as window_size from block_writers group by writer_id),
        b as (select block_id, writer_id, regexp_replace(hex(payload), '(..)', '\\1 ', 'g') as h from blocks where octet_length(payload) > 0),
        s as (select block_id, writer_id, unnest(regexp_extract_all(h, '{_STRETCH}')) as x from b)
        select block_id from s left join w on s.writer_id = w.writer_id group by block_id, window_size having max(length(x)) // 3 > coalesce(window_size, {WINDOW})""",
}
