"""Content tests and ASCII case folding, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import MAGIC

SAMPLE = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def looks_like_text(content: Column, sample: int = SAMPLE) -> Column:
    """Whether the first bytes look like text: no NUL, and less than 30% control characters besides tab and line ends.

    Empty content does; null gives null.
    """
    head = F.decode(F.substring(content, 1, sample), "ISO-8859-1")
    controls = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.when(F.length(head) == 0, True).otherwise(~F.contains(head, F.lit("\x00")) & (controls / F.length(head) < 0.3))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def contains_folded(text: Column, part: str) -> Column:
    """Whether ``text`` contains ``part``, ignoring the case of ASCII letters."""
    return F.contains(ascii_lower(text), F.lit(part.translate(str.maketrans(_UPPER, _LOWER))))


def is_mime(content: Column, kinds: list[str]) -> Column:
    """Whether content begins like a file of one of ``kinds``, however short it is; unknown kinds never do."""
    heads = [MAGIC[k] for k in kinds if k in MAGIC]
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(False)
    for h in heads:
        out = out | head.startswith(h)
    return out
