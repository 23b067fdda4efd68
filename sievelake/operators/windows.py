"""Scanning binary content in overlapping windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Rule
from . import match
from .scan import _RAW, _requests, _Results, assemble, engine_of

WINDOW, OVERLAP = 32768, 512


def window_starts(length: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Starts of the overlapping windows over ``length`` bytes; none for nothing.

    The step is the window without the overlap, or the window if that leaves
    nothing; the last window ends with the content.
    """
    step = window - overlap if window > overlap else window
    kept = overlap if window > overlap else 0
    return F.when(length > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), length - kept - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))


def explode_windows(df: DataFrame, content: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """One row per window: window_no, window_start, owned_end and its bytes as ``content``; other columns stay.

    A hit belongs to the window whose part before ``owned_end`` it begins in.
    """
    others = [c for c in df.columns if c != content]
    step = window - overlap if window > overlap else window
    n = F.octet_length(content)
    rows = df.select(*others, content, n.alias("__n"), F.posexplode(window_starts(n, window, overlap)).alias("window_no", "window_start"))
    last = F.col("window_start") + window >= F.col("__n")
    return rows.select(
        *others, "window_no", "window_start", F.when(last, F.col("__n")).otherwise(F.col("window_start") + step).alias("owned_end"),
        F.substring(content, F.col("window_start") + 1, F.lit(window)).alias(content),
    ).where(F.octet_length(content) > 0)


def scan_blocks(blocks: DataFrame, rules: list[Rule], label: str = "label", content: str = "content", base: str | None = None, window: int = WINDOW, overlap: int = OVERLAP, keep: list[str] | None = None, compat_negative: bool = False, owned: str | None = None) -> DataFrame:
    """Findings of all rules over binary contents, with absolute byte offsets.

    Content is read as one byte per character. A word or byte string counts
    wherever it stands, overlapping itself or not, and the condition between
    several asks of the whole content: ``and`` wants all of them anywhere,
    ``or`` takes the first listed that is present, under match-all every one.
    Patterns are matched in windows: a match counts once, where it begins, and
    at most a window's length of it is seen. Hits are in order of their
    position, ``base`` plus offset, at line 0. Sizes and expressions are asked
    of the content. Null and empty contents have no findings. ``owned`` names a
    column with the absolute end of the part whose hits are reported; what
    stands behind it only counts for conditions. Positions of all matches are
    what Spark lacks, hence Arrow.
    """
    keep = keep or [label]
    requests = [q for _, q in _requests(rules)]
    step = window - overlap if window > overlap else window
    event = {"raw": F.col("__content"), "path": F.col("__label"), "matched": F.col("__label"), "type": F.lit("file")}
    asked = [(i, j, match.matcher(m, F.lit(None), event)["has"]) for i, q in enumerate(requests) for j, m in enumerate(q.matchers) if m.type in ("size", "dsl")]
    slots = {(i, j): k for k, (i, j, _) in enumerate(asked)}
    verdicts = F.array(*[c for *_, c in asked]) if asked else F.array().cast("array<boolean>")
    at = F.coalesce(F.col(base), F.lit(0)).cast("long") if base else F.lit(0).cast("long")
    end = F.col(owned).cast("long") if owned else F.lit((1 << 63) - 1)
    rows = blocks.where(F.octet_length(content) > 0).select(*keep, F.col(label).alias("__label"), F.col(content).alias("__content"), at.alias("__base"), end.alias("__end"))
    rows = rows.select(*keep, "__content", "__base", "__end", verdicts.alias("__asked"))

    def spots(needles: list[tuple[str, bytes]], m, data: bytes) -> list[tuple[str, int]]:
        """The (value, position) of the byte strings that a word or binary matcher reports."""
        found = [[(value, k) for k in _positions(data, x)] for value, x in needles]
        if m.condition == "and":
            return [h for hits in found for h in hits] if found and all(found) else []
        return [h for hits in ([x for x in found if x] if m.match_all else [x for x in found if x][:1]) for h in hits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = engine_of(requests)
        listed = {(i, j): needles for i, q in enumerate(requests) for j, m in enumerate(q.matchers) if (needles := _needles(m)) is not None}
        for b in batches:
            take, rule, ms, es = [], [], _Results(), _Results()
            origins, limits, told = (b.column(c).to_pylist() for c in ("__base", "__end", "__asked"))
            for n, cell in enumerate(b.column("__content")):
                data = cell.as_py()
                low = data.lower()  # of bytes: ASCII letters only
                text, folded = data.decode("latin-1"), low.decode("latin-1")
                origin, limit = origins[n], limits[n]

                def matches(patterns: list[str], group: int, text: str = text) -> list[tuple[str, int]]:
                    out = []
                    for start in range(0, len(text), step):
                        w, last = text[start : start + window], start + window >= len(text)
                        for p in patterns:
                            rx = engine.pattern(p)
                            if rx and group <= rx.groups:
                                out += [(x[group] or "", start + x.start()) for x in rx.finditer(w) if last or x.start() < step]
                        if last:
                            break
                    return out

                def outcome(hits: list[tuple[str, int]], origin: int = origin, limit: int = limit) -> tuple[bool, list]:
                    return bool(hits), sorted(((v, 0, origin + k) for v, k in hits if origin + k < limit), key=lambda h: h[2])

                for i in engine.candidates(engine.present(folded), told[n]):
                    q = requests[i]
                    outcomes = []
                    for j, m in enumerate(q.matchers):
                        if (i, j) in slots:
                            outcomes.append((bool(told[n][slots[i, j]]), ()))
                        elif (i, j) in listed:
                            outcomes.append(outcome(spots(listed[i, j], m, low if m.case_insensitive and m.type == "word" else data)))
                        else:
                            outcomes.append(outcome(matches(m.regex, 0)))
                    extracts = [outcome(matches(e.regex, e.group) if e.type == "regex" else []) for e in q.extractors]
                    # Without a reported hit a part that is owned has no result of its own.
                    some = any(h for _, h in outcomes + extracts) or any(h and (i, j) in slots for j, (h, _) in enumerate(outcomes))
                    if some or any(m.negative for m in q.matchers):
                        take.append(n)
                        rule.append(i)
                        ms.add(outcomes)
                        es.add([(bool(h), h) for _, h in extracts])
            kept = [b.column(c).take(pa.array(take, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rule, pa.int32()), ms.arrow(), es.arrow()], names=[*keep, "rule", "m", "e"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return assemble(rows.mapInArrow(run, f"{schema}, rule int, {_RAW}"), rules, keep, compat_negative)


def _needles(m) -> list[tuple[str, bytes]] | None:
    """The (reported value, bytes looked for) of a word or binary matcher."""
    if m.type == "word":
        values = [w.encode().lower() if m.case_insensitive else w.encode() for w in m.words]
        return [(v.decode("latin-1"), v) for v in values if v]
    return [(x, bytes.fromhex(x)) for x in m.binary if x] if m.type == "binary" else None


def _positions(data: bytes, x: bytes) -> Iterator[int]:
    at = data.find(x)
    while at >= 0:
        yield at
        at = data.find(x, at + 1)


def window_hits(df: DataFrame, content: str, pattern: str, keep: list[str], window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` and (hit_offset, value) of every match of a pattern in binary contents, each counted once."""
    rx = re.compile(pattern.encode("latin-1"))
    rows = explode_windows(df.select(*keep, content), content, window, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, offsets, values = [], [], []
            starts, owned = b.column("window_start").to_pylist(), b.column("owned_end").to_pylist()
            for n, w in enumerate(b.column(content)):
                for m in rx.finditer(w.as_py()):
                    if starts[n] + m.start() < owned[n]:
                        take.append(n)
                        offsets.append(starts[n] + m.start())
                        values.append(m[0].decode("latin-1"))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(take, pa.int64())) for c in keep], pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=[*keep, "hit_offset", "value"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, f"{schema}, hit_offset long, value string")
