"""Arrow batches cut to a bounded amount of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text analysed at once; a longer text forms a slice of its own.
SLICE = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of at most ``size`` bytes of ``column`` or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > size:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)
