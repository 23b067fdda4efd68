"""Chunk streams: lines and windows put together from chunks by keyed state.

Both take a streaming frame of chunks (``label``, ``seq``, ``data`` binary,
``is_last``) and assemble per label what rows of the batch operators are.
``seq`` numbers a label's chunks from 0 on; they may arrive in any order and
more than once: a chunk that comes early is held back until those before it
have come. A stream ends with the chunk marked ``is_last``, once all before it
are there; its state is dropped then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.rules import Rule

LINE = "label string, line string, byte_offset long, line_no long"
WINDOW_ROW = "label string, window_start long, owned_end long, content binary"


#: What both keep of a stream: the next number, the chunks that came early, the number of the last one or -1.
_HELD = "following long, held_seq array<long>, held array<binary>, last long"


class _Arrivals:
    """The chunks of one stream in their order."""

    def __init__(self, following: int = 0, seqs: list[int] = (), held: list[bytes] = (), last: int = -1):
        self.following, self.last = following, last
        self.held = {int(n): bytes(d) for n, d in zip(seqs, held)}

    def take(self, batches: Iterator[pd.DataFrame]) -> list[bytes]:
        """The chunks whose turn it is, after those of ``batches`` have come."""
        for b in batches:
            for seq, data, is_last in zip(b["seq"], b["data"], b["is_last"]):
                if seq >= self.following:
                    self.held.setdefault(int(seq), bytes(data or b""))
                if is_last:
                    self.last = int(seq)
        ready = []
        while self.following in self.held:
            ready.append(self.held.pop(self.following))
            self.following += 1
        return ready

    @property
    def ended(self) -> bool:
        return 0 <= self.last < self.following

    def state(self) -> tuple:
        seqs = sorted(self.held)
        return self.following, seqs, [self.held[n] for n in seqs], self.last


def _lines(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    parts, at, number, *kept = state.get if state.exists else ([], 0, 0)
    arrivals, parts, rows = _Arrivals(*kept), [bytes(x) for x in parts], []

    def emit(raw: bytes) -> None:
        nonlocal at, number
        number += 1
        line = raw[:-1] if raw.endswith(b"\r") else raw
        if line:
            rows.append((key[0], line.decode("utf-8", "replace"), at, number))
        at += len(raw) + 1

    for data in arrivals.take(batches):
        first, *others = data.split(b"\n")
        parts.append(first)
        for x in others:  # each ends the line before it
            emit(b"".join(parts))
            parts = [x]
    if arrivals.ended:
        if rest := b"".join(parts):
            emit(rest)
        state.remove()
    else:
        state.update((parts, at, number, *arrivals.state()))
    yield pd.DataFrame(rows, columns=["label", "line", "byte_offset", "line_no"])


def assemble_lines(chunks: DataFrame) -> DataFrame:
    """The completed lines of chunk streams, without blank ones; the unfinished last line comes with the stream's end.

    Lines carry their number and byte offset in the stream. State holds an
    unfinished line and the chunks that came early.
    """
    return chunks.groupBy("label").applyInPandasWithState(_lines, LINE, f"parts array<binary>, at long, number long, {_HELD}", "append", GroupStateTimeout.NoTimeout)


def _windower(window: int, overlap: int):
    step = window - overlap if window > overlap else window

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, at, *kept = state.get if state.exists else (b"", 0)
        arrivals, rows, rest, begin = _Arrivals(*kept), [], bytearray(rest), 0
        for data in arrivals.take(batches):
            rest += data
            # A full window is given out once something follows it: only the last window owns its overlap.
            while len(rest) - begin > window:
                rows.append((key[0], at, at + step, bytes(rest[begin : begin + window])))
                begin, at = begin + step, at + step
            if begin:
                del rest[:begin]
                begin = 0
        if arrivals.ended:
            if rest:
                rows.append((key[0], at, at + len(rest), bytes(rest)))
            state.remove()
        else:
            state.update((bytes(rest), at, *arrivals.state()))
        yield pd.DataFrame(rows, columns=["label", "window_start", "owned_end", "content"])

    return run


def assemble_windows(chunks: DataFrame, window: int = 32768, overlap: int = 512) -> DataFrame:
    """The overlapping windows of chunk streams, with their start in the stream and the end of the part they own.

    State holds less than a window and the chunks that came early. Windows
    equal those of the whole content, so hits beginning before ``owned_end``
    count once.
    """
    return chunks.groupBy("label").applyInPandasWithState(_windower(window, overlap), WINDOW_ROW, f"rest binary, at long, {_HELD}", "append", GroupStateTimeout.NoTimeout)


def scan_line_stream(chunks: DataFrame, rules: list[Rule], engine: str = "auto") -> DataFrame:
    """Findings of each line of chunk streams by itself, as lines arrive."""
    from ..operators.scan import scan

    return scan(assemble_lines(chunks), rules, "label", "line", keep=["label", "line_no", "byte_offset"], engine=engine)


def scan_block_stream(chunks: DataFrame, rules: list[Rule], window: int = 32768, overlap: int = 512) -> DataFrame:
    """Findings of each window of chunk streams by itself, positions counted from the stream's start.

    A window's conditions ask of its whole content; hits in its owned part are reported.
    """
    from ..operators.windows import scan_blocks

    return scan_blocks(assemble_windows(chunks, window, overlap), rules, "label", "content", "window_start", window, 0, keep=["label", "window_start"], owned="owned_end")
