"""Matchers and extractors as columns over the lines of a document.

Each gives ``struct<has boolean, hits array<struct<value, line, byte_offset>>>``
for a whole document; hits are in line order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import regex
from ..functions.regex import folded
from ..plans.rules import DSL, Extractor, Matcher
from .lines import offset_of

HIT = "struct<value:string,line:int,byte_offset:bigint>"
RESULT = f"struct<has:boolean,hits:array<{HIT}>>"


def _none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def _result(hits: Column) -> Column:
    return F.named_struct(F.lit("has"), F.size(hits) > 0, F.lit("hits"), hits)


def _verdict(has: Column) -> Column:
    return F.named_struct(F.lit("has"), F.coalesce(has, F.lit(False)), F.lit("hits"), _none())


def _per_line(lines: Column, values) -> Column:
    """Hits of ``values(line text, folded line text)``, an array column, over all lines.

    ``lines`` are structs of line_no, line and low; the byte offset is computed
    for hits only, from the columns ``__parts`` and ``__starts`` of the document.
    """
    before = lambda l: offset_of(l["line_no"] - 1, F.col("__parts"), F.col("__starts"))
    return F.flatten(
        F.transform(lines, lambda l: F.transform(values(l["line"], l["low"]), lambda v: F.named_struct(F.lit("value"), v, F.lit("line"), l["line_no"], F.lit("byte_offset"), before(l))))
    )


def contains_any(text: Column, lits: list[str]) -> Column:
    out = None
    for x in lits:
        test = F.contains(text, F.lit(x))
        out = test if out is None else out | test
    return F.lit(False) if out is None else out


def _guard(text: Column, low: Column | None, pattern: str) -> Column | None:
    exact = regex.exact_literals(pattern)
    if exact:
        return contains_any(text, exact)
    lits = regex.literals(pattern)
    return contains_any(folded(text) if low is None else low, lits) if lits else None


def find_all(text: Column, pattern: str, group: int = 0, low: Column | None = None) -> Column:
    """All matches of an RE2 pattern in ``text``, tested first for the pattern's literals.

    ``low`` is the folded text where it is at hand. A pattern or group that
    cannot be evaluated finds nothing.
    """
    none = F.array().cast("array<string>")
    try:
        java = regex.to_java(pattern)
    except regex.Unsupported:
        return none
    if regex._parsed(pattern) is None or group > regex.groups(pattern):
        return none
    found = F.regexp_extract_all(text, F.lit(java), group)
    guard = _guard(text, low, pattern)
    return found if guard is None else F.when(guard, found).otherwise(none)


def _all_found(text: Column, patterns: list[str], group: int, low: Column) -> Column:
    found = [find_all(text, p, group, low) for p in patterns]
    return found[0] if len(found) == 1 else F.flatten(F.array(*found))


def words_found(text: Column, m: Matcher, low: Column | None = None) -> Column:
    """The words that a word matcher reports for ``text``: all of them under ``and``, those present under match-all, else the first."""
    corpus = F.lower(text) if m.case_insensitive else text
    words = [w.lower() if m.case_insensitive else w for w in m.words]
    if not words:
        return F.array().cast("array<string>")
    none, listed = F.array().cast("array<string>"), F.array(*[F.lit(w) for w in words])
    present = F.filter(listed, lambda w: F.contains(corpus, w))
    if m.condition == "and":
        out = F.when(F.size(present) == len(words), listed).otherwise(none)
    else:
        out = present if m.match_all else F.slice(present, 1, 1)
    # The fold finds all that lower case finds: most lines are done with here.
    return F.when(contains_any(low, words), out).otherwise(none) if m.case_insensitive and low is not None else out


def bytes_found(text: Column, m: Matcher) -> Column:
    """The byte strings (hexadecimal) of a binary matcher that ``text`` contains; all under ``and``, else the first."""
    listed = F.array(*[F.lit(x) for x in m.binary]) if m.binary else F.array().cast("array<string>")
    raw = text if isinstance(text, Column) else F.col(text)
    present = F.filter(listed, lambda x: F.contains(raw.cast("binary"), F.unhex(x)))
    if m.condition == "and":
        return F.when(F.size(present) == len(m.binary), listed).otherwise(F.array().cast("array<string>"))
    return present if m.match_all else F.slice(present, 1, 1)


_PARTS = {"", "body", "all", "data", "raw"}


def part(event: dict[str, Column], name: str | None) -> Column:
    """A part of an event: the raw content under its several names, else a named one, else nothing."""
    if (name or "") in _PARTS:
        return event["raw"]
    return F.coalesce(event[name], F.lit("")) if name in event else F.lit("")


def expression(text: str, event: dict[str, Column]) -> Column | None:
    """A condition of the small expression language as a column; None if it isn't one."""
    for joint, op in ((" || ", "or"), (" && ", "and")):
        if joint in text:
            sides = [expression(x, event) for x in text.split(joint)]
            if any(s is None for s in sides):
                return None
            out = sides[0]
            for s in sides[1:]:
                out = out & s if op == "and" else out | s
            return out
    m = DSL.match(text)
    if not m:
        return None
    if m[5]:
        value = part(event, m[6])
        return {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[m[5]](value, F.lit(m[7]))
    left = F.octet_length(part(event, m[1])) if m[1] else part(event, m[2])
    right = F.lit(int(m[4])) if m[4].isdigit() else F.lit(m[4][1:-1])
    return {"==": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[m[3]]


def combined(tests: list[Column | None], condition: str) -> Column:
    out = None
    for t in tests:
        t = F.lit(False) if t is None else t
        out = t if out is None else (out & t if condition == "and" else out | t)
    return F.lit(False) if out is None else out


def of_content(x: Matcher | Extractor) -> bool:
    """Whether an operator looks at the content, not at a named part of the event such as its path."""
    return (x.part or "") in _PARTS


def _of_part(values: Column) -> Column:
    """The result of values found in a named part: they stand at no line."""
    return _result(F.transform(values, lambda v: F.named_struct(F.lit("value"), v, F.lit("line"), F.lit(0), F.lit("byte_offset"), F.lit(0).cast("long"))))


def matcher(m: Matcher, lines: Column, event: dict[str, Column], legacy: bool = False) -> Column:
    """The result of a matcher on a document, before negation.

    Words, patterns and bytes are looked for in each line, or in the named part
    that the matcher asks for. Sizes and expressions are asked of the whole
    content and have no hits. ``legacy`` applies a pattern matcher's condition
    and match-all within each line; else every match of any pattern counts.
    """
    if not of_content(m) and m.type in ("word", "binary", "regex"):
        text = part(event, m.part)
        return _of_part(words_found(text, m) if m.type == "word" else bytes_found(text, m) if m.type == "binary" else regex_found(text, m))
    if m.type == "regex" and legacy:
        return _result(_per_line(lines, lambda t, low: regex_found(t, m)))
    if m.type == "word":
        return _result(_per_line(lines, lambda t, low: words_found(t, m, low)))
    if m.type == "binary":
        return _result(_per_line(lines, lambda t, low: bytes_found(t, m)))
    if m.type == "regex":
        return _result(_per_line(lines, lambda t, low: _all_found(t, m.regex, 0, low)) if m.regex else _none())
    if m.type == "size":
        return _verdict(F.octet_length(part(event, m.part)).isin([int(x) for x in m.size]))
    if m.type == "dsl":
        return _verdict(combined([expression(x, event) for x in m.dsl], m.condition))
    return _verdict(F.lit(False))


def regex_found(text: Column, m: Matcher) -> Column:
    """A regex matcher on one token: the matches of the first pattern that has any; of all under ``and`` if all have some, or under match-all."""
    found = [find_all(text, p) for p in m.regex]
    if not found:
        return F.array().cast("array<string>")
    if m.condition == "and":
        every = combined([F.size(x) > 0 for x in found], "and")
        return F.when(every, F.flatten(F.array(*found))).otherwise(F.array().cast("array<string>"))
    if m.match_all:
        return F.flatten(F.array(*found))
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array().cast("array<string>"))


def extractor(e: Extractor, lines: Column, event: dict[str, Column]) -> Column:
    """The result of an extractor on a document.

    Patterns give the chosen group of every match, an unmatched one as an empty
    value. Keys give the event's values, expressions their value as text; both
    are taken from the whole content, at line 0.
    """
    if e.type == "regex" and not of_content(e):
        text = part(event, e.part)
        return _of_part(_all_found(text, e.regex, e.group, folded(text)) if e.regex else F.array().cast("array<string>"))
    if e.type == "regex":
        return _result(_per_line(lines, lambda t, low: _all_found(t, e.regex, e.group, low)) if e.regex else _none())
    whole = lambda v: F.named_struct(F.lit("value"), v.cast("string"), F.lit("line"), F.lit(0), F.lit("byte_offset"), F.lit(0).cast("long"))
    values = [event[k] for k in e.kval if k in event] if e.type == "kval" else [x for x in (expression(d, event) for d in e.dsl) if x is not None]
    return _result(F.filter(F.array(*[whole(v) for v in values]), lambda h: h["value"].isNotNull()) if values else _none())
