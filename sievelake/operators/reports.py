"""What is made of findings: events, statistics, histograms, baselines, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import SEVERITIES


def fan_out(findings: DataFrame, label: str = "label") -> DataFrame:
    """One event per named matcher, else per named extractor, else one per finding."""
    by_match = F.transform(F.map_keys("matches"), lambda k: F.struct(k.alias("matcher_name"), F.lit(None).cast("string").alias("extractor_name"), F.col("output_extracts").alias("extracted_results")))
    by_extract = F.transform(F.map_entries("named_extracts"), lambda e: F.struct(F.lit(None).cast("string").alias("matcher_name"), e["key"].alias("extractor_name"), e["value"].alias("extracted_results")))
    single = F.array(F.struct(F.lit(None).cast("string").alias("matcher_name"), F.lit(None).cast("string").alias("extractor_name"), F.col("output_extracts").alias("extracted_results")))
    which = F.when(F.size("matches") > 0, by_match).when(F.size("named_extracts") > 0, by_extract).otherwise(single)
    return findings.select("template_id", F.lit("file").alias("type"), F.col(label).alias("path"), F.col(label).alias("matched"), F.inline(which), F.current_timestamp().alias("at"))


def _appended(maps: Column) -> Column:
    """One map of a list of maps: the values of equal keys, which are arrays, one after the other."""
    names = F.array_distinct(F.flatten(F.transform(maps, lambda m: F.map_keys(m))))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.flatten(F.filter(F.transform(maps, lambda m: F.try_element_at(m, n)), lambda x: x.isNotNull())))))


def merge_rules(findings: DataFrame, label: str | None = "label") -> DataFrame:
    """Findings of a rule's several requests on one document joined into one.

    Flags are joined by or; matches and named extracts of one name, extracts
    and output extracts are appended in the order of requests. Without
    ``label`` the findings of all documents are joined, in order of ``file``
    or ``label`` too; a rule's hits must then fit one row.
    """
    place = next((c for c in ("label", "file", "path") if c in findings.columns), None)
    order = ["request", *([place] if place and not label else [])]
    kept = ["matches", "named_extracts", "extracts", "output_extracts"]
    one = F.struct(*order, *kept)
    ordered = F.array_sort(F.collect_list(one), lambda x, y: _compared(x, y, order))
    rows = findings.groupBy(*([label] if label else []), "template_id").agg(
        F.min("template_name").alias("template_name"), F.min("severity").alias("severity"),
        F.bool_or("matched").alias("matched"), F.bool_or("extracted").alias("extracted"), ordered.alias("__parts"),
    )
    return rows.select(
        *([label] if label else []), "template_id", "template_name", "severity", "matched", "extracted",
        _appended(F.col("__parts.matches")).alias("matches"), _appended(F.col("__parts.named_extracts")).alias("named_extracts"),
        F.flatten("__parts.extracts").alias("extracts"), F.flatten("__parts.output_extracts").alias("output_extracts"),
    )


def _compared(x: Column, y: Column, fields: list[str]) -> Column:
    out = F.lit(0)
    for f in reversed(fields):
        out = F.when(x[f] < y[f], -1).when(x[f] > y[f], 1).otherwise(out)
    return out


def severity_histogram(findings: DataFrame) -> DataFrame:
    """``(severity, severity_rank, n_findings)``, the known severities ranked from critical on, others and null after them."""
    s = F.coalesce("severity", F.lit("unknown"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("severity")), F.lit(0)), F.lit(len(SEVERITIES) + 1)).cast("int")
    return findings.groupBy(s.alias("severity")).agg(F.count("*").alias("n_findings")).withColumn("severity_rank", F.coalesce(rank, F.lit(len(SEVERITIES) + 1)))


def new_findings(findings: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """The findings whose ``keys`` the baseline doesn't have; null keys equal null keys."""
    a, b = findings.alias("a"), baseline.select(*keys).distinct().alias("b")
    on = None
    for k in keys:
        test = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = test if on is None else on & test
    return a.join(b, on, "left_anti")


def save_baseline(findings: DataFrame, path: str, keys: list[str]) -> None:
    """Writes the distinct ``keys`` of findings as a baseline for ``new_findings``."""
    findings.select(*keys).distinct().write.mode("overwrite").parquet(path)


def fails(findings: DataFrame, severity: str) -> bool:
    """Whether some finding is at least of the given severity; unknown severities are below all."""
    return not findings.where(F.col("severity").isin(list(SEVERITIES[: SEVERITIES.index(severity) + 1]))).isEmpty()


def statistics(docs: DataFrame, content: str, findings: DataFrame, n_rules: int) -> DataFrame:
    """One row of counters: files, bytes, findings, rules."""
    d = docs.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("long").alias("bytes")).withColumn("one", F.lit(1))
    f = findings.agg(F.count("*").alias("findings")).withColumn("one", F.lit(1))
    return d.join(f, "one").select("files", "bytes", "findings", F.lit(n_rules).alias("rules"))


def as_json(findings: DataFrame, label: str = "label") -> DataFrame:
    """``json``: a finding per row in the exchange form."""
    hits = lambda c: F.transform(c, lambda h: F.struct(h["value"].alias("value"), h["line"].alias("line"), h["byte_offset"].alias("offset")))
    return findings.select(
        F.to_json(
            F.struct(
                F.col("template_id").alias("template-id"), F.col("template_name").alias("template-name"), "severity", F.col(label).alias("file"),
                F.transform_values("matches", lambda _, v: hits(v)).alias("matches"), hits(F.col("extracts")).alias("extracts"),
            )
        ).alias("json")
    )


def as_lines(findings: DataFrame, label: str = "label", limit: int = 200) -> DataFrame:
    """The label and ``text``: a heading per finding and a line per event, values cut after ``limit`` bytes."""
    cut = lambda v: F.when(F.octet_length(v) > limit, F.concat(F.make_valid_utf8(F.substring(v.cast("binary"), 1, limit).cast("string")), F.lit("..."))).otherwise(v)
    head = F.concat(F.lit("["), F.col("template_name"), F.lit("] ["), F.col("severity"), F.lit("] ["), F.col("template_id"), F.lit("] "), F.col(label))
    of_matches = F.flatten(F.transform(F.map_entries("matches"), lambda e: F.transform(e["value"], lambda h: F.concat(F.lit("   ["), e["key"], F.lit("] [L"), h["line"].cast("string"), F.lit("] "), cut(h["value"])))))
    of_extracts = F.transform("extracts", lambda h: F.concat(F.lit("   [L"), h["line"].cast("string"), F.lit("] "), cut(h["value"])))
    return findings.select(label, F.array_join(F.concat(F.array(head), of_matches, of_extracts), "\n").alias("text"))
