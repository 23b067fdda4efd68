"""Lines of a text with numbers and byte offsets, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(text: Column) -> Column:
    """The text between line feeds; a final line feed ends the last line and begins none."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(text: Column) -> Column:
    """``array<struct<line_no, byte_offset, line>>`` of a text.

    Numbers begin at 1, the offset is that of the line's first byte; one
    carriage return at a line's end belongs to the line end. Blank lines count,
    an empty text has no line, null gives null.
    """
    return _with_offsets(text, _full)


def legacy_lines(text: Column) -> Column:
    """As ``lines``, with the older offsets that leave out the carriage returns before."""
    return _with_offsets(text, lambda raw: F.octet_length(without_return(raw)) + 1)


def bare_lines(text: Column) -> Column:
    """As ``lines``, with offsets that leave out all line ends before."""
    return _with_offsets(text, lambda raw: F.octet_length(without_return(raw)))


#: Lines of a block. Offsets are summed from the block's start, so their cost grows with the text, not with its square.
BLOCK = 64


def _full(raw: Column) -> Column:
    return F.octet_length(raw) + 1


def _sum(parts: Column, width) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, raw: n + width(raw))


def block_starts(parts: Column, width=_full) -> Column:
    """Offsets of every BLOCK-th line."""
    widths = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: _sum(F.slice(parts, i + 1, F.lit(BLOCK)), width))
    start = F.named_struct(F.lit("at"), F.lit(0).cast("long"), F.lit("starts"), F.array().cast("array<bigint>"))
    return F.aggregate(widths, start, lambda s, w: F.named_struct(F.lit("at"), s["at"] + w, F.lit("starts"), F.array_append(s["starts"], s["at"])), lambda s: s["starts"])


def offset_of(index: Column, parts: Column, starts: Column, width=_full) -> Column:
    """Offset of the line at ``index`` (from 0)."""
    block = F.floor(index / BLOCK).cast("int")
    return F.get(starts, block) + _sum(F.slice(parts, block * BLOCK + 1, F.pmod(index, F.lit(BLOCK))), width)


def without_return(raw: Column) -> Column:
    """A line without one carriage return at its end."""
    return F.when(F.endswith(raw, F.lit("\r")), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)


def _with_offsets(text: Column, width) -> Column:
    parts = pieces(text)
    starts = block_starts(parts, width)
    return F.transform(parts, lambda raw, i: F.named_struct(F.lit("line_no"), i + 1, F.lit("byte_offset"), offset_of(i, parts, starts, width), F.lit("line"), without_return(raw)))


def explode_lines(df: DataFrame, text: str, kind=lines) -> DataFrame:
    """One row per line of ``text``, which is dropped; other columns stay."""
    others = [c for c in df.columns if c != text]
    width = {lines: _full, legacy_lines: lambda raw: F.octet_length(without_return(raw)) + 1, bare_lines: lambda raw: F.octet_length(without_return(raw))}[kind]
    # The parts and block starts are columns of their own, made once per text.
    rows = df.where(F.col(text) != "").select(*others, pieces(F.col(text)).alias("__parts"))
    rows = rows.select(*others, "__parts", block_starts(F.col("__parts"), width).alias("__starts"))
    rows = rows.select(*others, "__starts", "__parts", F.posexplode("__parts").alias("__i", "__raw"))
    return rows.select(*others, (F.col("__i") + 1).alias("line_no"), offset_of(F.col("__i"), F.col("__parts"), F.col("__starts"), width).alias("byte_offset"), without_return(F.col("__raw")).alias("line"))
