"""The queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import frequent, leaks, linkage, mixing, pieces, quality, secrets

QUERIES = {
    "p1_found": secrets.p1_found,
    "p1_redacted": secrets.p1_redacted,
    "p2_found": linkage.p2_found,
    "p4_found": pieces.p4_found,
    "p4_pieces": pieces.p4_pieces,
    "p4_regions": pieces.p4_regions,
    "p5_found": frequent.p5_found,
    "p5_top": frequent.p5_top,
    "p6_found": leaks.p6_found,
    "p6_scores": leaks.p6_scores,
    "p7_found": mixing.p7_found,
    "p7_report": mixing.p7_report,
    "p8_found": quality.p8_found,
    "p8_kinds": quality.p8_kinds,
    "p8_stats": quality.p8_stats,
}
SQL = {**frequent.SQL, **pieces.SQL, **quality.SQL}
