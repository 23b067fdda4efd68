"""All core queries and their SQL.

Each query runs over the whole of its tables. Arrays and maps come out as
sorted, joined text, so that engines can be compared.
"""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, regex, text
from .operators import match, reports, scan, windows
from .operators.lines import bare_lines, explode_lines, legacy_lines
from .operators.skew import P3_QUERIES, P3_SQL
from .plans.rules import Extractor, Matcher, Request, Rule, adhoc, choose, from_table, grouped, request_literals
from .plans.session import scratch_path, spread, table
from .sources import files as sources
from .streaming import writers

CASES, MILLIONS = r"(?i)of (\d+) cases", r"(?i)\b(?:by|um|pour) (\d+)\s+mill"
TOKEN = r"(?i)(?:token|secret|password)\s*[:=]\s*[\"']?(\w[\w\-.]{7,})"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as (label, content): the speeches' texts under their ids."""
    return spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("label"), F.col("text").alias("content")), "label")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines as (label, content), redelivered ones once."""
    return spread(table(spark, sf, "file_matches").select(F.col("match_id").cast("string").alias("label"), F.col("raw_line").alias("content")), "label").distinct()


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return explode_lines(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "text")


def _joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), "|")


def _hits(c: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.transform(c, lambda h: F.struct(h["line"].alias("l"), h["byte_offset"].alias("o"), h["value"].alias("v")))), lambda h: F.concat_ws(":", h["l"], h["o"], h["v"])), "|")


# SQL of the lines of documents and of raw lines.
def _lines_sql(source: str, key: str, column: str, width: str = "strlen(raw) + 1") -> str:
    return f"""
        select {key}, line_no, regexp_replace(raw, '\\r$', '') as line,
               coalesce(sum({width}) over (partition by {key} order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset
        from (select {key}, unnest(parts) as raw, generate_subscripts(parts, 1)::int as line_no
              from (select {key}, case when p[len(p)] = '' then p[1 : len(p) - 1] else p end as parts
                    from (select {key}, string_split({column}, chr(10)) as p from {source} where {column} <> '')))"""


_STRIPPED = "strlen(regexp_replace(raw, '\\r$', ''))"
DOC_LINES = _lines_sql("documents", "doc_id", "text")
RAW = "(select distinct match_id::varchar as label, raw_line from file_matches)"
RAW_LINES = _lines_sql(RAW, "label", "raw_line")
LABEL_LINES = _lines_sql("(select doc_id::varchar as label, text from documents)", "label", "text")

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- lines -----------------------------------------------------------------


@query("lines_explode", f"select doc_id, line_no, byte_offset, line from ({DOC_LINES})")
def lines_explode(spark, sf):
    return _lines(spark, sf)


@query("lines_legacy_offset", f"select doc_id, line_no, byte_offset, line from ({_lines_sql('documents', 'doc_id', 'text', _STRIPPED + ' + 1')})")
def lines_legacy_offset(spark, sf):
    return explode_lines(table(spark, sf, "documents").select("doc_id", "text"), "text", legacy_lines)


@query("lines_bare_offset", f"select doc_id, line_no, byte_offset, line from ({_lines_sql('documents', 'doc_id', 'text', _STRIPPED)})")
def lines_bare_offset(spark, sf):
    return explode_lines(table(spark, sf, "documents").select("doc_id", "text"), "text", bare_lines)


@query("whole_file_token", "select doc_id::varchar as label, md5(regexp_extract(text, '(?s)Madam.*million')) as found from documents where regexp_matches(text, '(?s)Madam.*million')")
def whole_file_token(spark, sf):
    rule = Rule("r", requests=[Request(matchers=[Matcher("regex", name="m", regex=["(?s)Madam.*million"])])])
    hits = scan.scan(_docs(spark, sf), [rule], whole=True).select("label", F.explode(F.element_at("matches", "m")).alias("h"))
    return hits.select("label", F.md5(F.col("h.value").cast("binary")).alias("found"))


# ---- patterns, matchers and extractors per line --------------------------------


def _per_line(spark, sf, values) -> DataFrame:
    """Lines of documents with the values found in them, one row each."""
    found = _lines(spark, sf).select("doc_id", "line_no", "byte_offset", values(F.col("line")).alias("v"))
    return found.select("doc_id", "line_no", "byte_offset", F.explode("v").alias("found"))


def _unnested(values: str, where: str = "true") -> str:
    return f"select doc_id, line_no, byte_offset, unnest({values}) as found from ({DOC_LINES}) where {where}"


@query("scan_regex_extract", _unnested(f"regexp_extract_all(line, '{CASES}', 0)"))
def scan_regex_extract(spark, sf):
    return _per_line(spark, sf, lambda t: match.find_all(t, CASES))


@query("scan_regex_group", _unnested(f"regexp_extract_all(line, '{MILLIONS}', 1)"))
def scan_regex_group(spark, sf):
    return _per_line(spark, sf, lambda t: match.find_all(t, MILLIONS, 1))


@query("scan_regex_distinct", f"select distinct doc_id, found from ({_unnested(f'''regexp_extract_all(line, '{CASES}', 1)''')})")
def scan_regex_distinct(spark, sf):
    return _per_line(spark, sf, lambda t: match.find_all(t, CASES, 1)).select("doc_id", "found").distinct()


@query("scan_regex_unmatched_group", "select label, line_no, unnest(list_transform(regexp_extract_all(line, '(api)?_?key', 1), lambda x: coalesce(x, ''))) as found from (" + RAW_LINES + ")")
def scan_regex_unmatched_group(spark, sf):
    ls = explode_lines(_matches(spark, sf), "content")
    return ls.select("label", "line_no", F.explode(match.find_all(F.col("line"), "(api)?_?key", 1)).alias("found"))


WORDS = ["treaty", "harbour", "budget"]
_W = "['treaty', 'harbour', 'budget']"


@query("match_word_or", _unnested(f"list_filter({_W}, lambda w: contains(line, w))[1:1]"))
def match_word_or(spark, sf):
    return _per_line(spark, sf, lambda t: match.words_found(t, Matcher(words=WORDS)))


@query("match_word_and", _unnested("['treaty', 'harbour']", "contains(line, 'treaty') and contains(line, 'harbour')"))
def match_word_and(spark, sf):
    return _per_line(spark, sf, lambda t: match.words_found(t, Matcher(words=WORDS[:2], condition="and")))


@query("match_word_all", _unnested(f"list_filter({_W}, lambda w: contains(line, w))"))
def match_word_all(spark, sf):
    return _per_line(spark, sf, lambda t: match.words_found(t, Matcher(words=WORDS, match_all=True)))


@query("match_word_ci", _unnested(f"list_filter({_W}, lambda w: contains(lower(line), w))[1:1]"))
def match_word_ci(spark, sf):
    return _per_line(spark, sf, lambda t: match.words_found(t, Matcher(words=["Treaty", "HARBOUR", "budget"], case_insensitive=True)))


@query("match_regex", _unnested("list_concat(regexp_extract_all(line, 'in (19|20)\\d\\d', 0), regexp_extract_all(line, '[A-Z]\\w+vik', 0))"))
def match_regex(spark, sf):
    return _per_line(spark, sf, lambda t: F.concat(match.find_all(t, r"in (19|20)\d\d"), match.find_all(t, r"[A-Z]\w+vik")))


@query("match_regex_and", _unnested("list_concat(regexp_extract_all(line, '\\d+ million', 0), regexp_extract_all(line, 'In \\d+', 0))", "regexp_matches(line, '\\d+ million') and regexp_matches(line, 'In \\d+')"))
def match_regex_and(spark, sf):
    return _per_line(spark, sf, lambda t: match.regex_found(t, Matcher("regex", regex=[r"\d+ million", r"In \d+"], condition="and")))


@query("match_regex_or", _unnested("case when regexp_matches(line, '\\d+ million') then regexp_extract_all(line, '\\d+ million', 0) else regexp_extract_all(line, 'In \\d+', 0) end"))
def match_regex_or(spark, sf):
    return _per_line(spark, sf, lambda t: match.regex_found(t, Matcher("regex", regex=[r"\d+ million", r"In \d+"])))


@query("match_regex_legacy", "select distinct doc_id::varchar as label from (" + DOC_LINES + ") where regexp_matches(line, '\\d+ million') and regexp_matches(line, 'In \\d+')")
def match_regex_legacy(spark, sf):
    rule = Rule("r", requests=[Request(matchers=[Matcher("regex", regex=[r"\d+ million", r"In \d+"], condition="and")])])
    return scan.scan(_docs(spark, sf), [rule], legacy=True).select("label")


@query("match_named_part", "select doc_id::varchar as label from documents where text <> '' and contains(doc_id::varchar, '77')")
def match_named_part(spark, sf):
    return scan.scan(_docs(spark, sf), [Rule("r", requests=[Request(matchers=[Matcher(part="path", words=["77"])])])]).select("label")


@query("match_binary", _unnested("['7472656174']", "contains(line, 'treat')"))
def match_binary(spark, sf):
    return _per_line(spark, sf, lambda t: match.bytes_found(t, Matcher("binary", binary=["7472656174"])))


@query("match_size", "select label, strlen(raw_line)::int as n_bytes from " + RAW + " where strlen(raw_line) in (40, 41, 42)")
def match_size(spark, sf):
    d = _matches(spark, sf)
    m = match.matcher(Matcher("size", size=[40, 41, 42]), F.lit(None), {"raw": F.col("content")})
    return d.where(m["has"]).select("label", F.octet_length("content").alias("n_bytes"))


@query("match_dsl_len", "select label from " + RAW + " where strlen(raw_line) > 200 and contains(raw_line, 'key')")
def match_dsl_len(spark, sf):
    m = match.matcher(Matcher("dsl", dsl=["len(raw) > 200 && contains(body, 'key')"]), F.lit(None), {"raw": F.col("content")})
    return _matches(spark, sf).where(m["has"]).select("label")


@query("match_part", "select label from " + RAW + " where contains(label, '77') and not contains(raw_line, 'key')")
def match_part(spark, sf):
    d, event = _matches(spark, sf), {"raw": F.col("content"), "path": F.col("label")}
    has = match.expression("contains(path, '77')", event) & ~match.expression("contains(all, 'key')", event)
    return d.where(has).select("label")


@query("match_negative", "select doc_id::varchar as label from documents where text <> '' and not contains(text, 'million')")
def match_negative(spark, sf):
    rule = Rule("quiet", requests=[Request(matchers=[Matcher(words=["million"], negative=True)])])
    return scan.scan(_docs(spark, sf), [rule]).select("label")


@query("extract_kval", "select event_id::varchar as label, event_type as found from events where event_type is not null")
def extract_kval(spark, sf):
    e = table(spark, sf, "events")
    x = match.extractor(Extractor("kval", kval=["kind"]), F.lit(None), {"raw": F.col("props"), "kind": F.col("event_type")})
    return e.select(F.col("event_id").cast("string").alias("label"), F.explode(x["hits"]["value"]).alias("found"))


@query("extract_dsl", "select event_id::varchar as label, (strlen(props) > 10)::varchar as found from events where props is not null")
def extract_dsl(spark, sf):
    x = match.extractor(Extractor("dsl", dsl=["len(raw) > 10"]), F.lit(None), {"raw": F.col("props")})
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("label"), F.explode(x["hits"]["value"]).alias("found"))


# ---- findings -------------------------------------------------------------------

_LINE_HITS = "select label, line_no, byte_offset, unnest({values}) as v from (" + LABEL_LINES + ")"


def _hit_list(values: str) -> str:
    return f"select label, string_agg(line_no || ':' || byte_offset || ':' || v, '|' order by line_no, byte_offset, v) as hits from ({_LINE_HITS.format(values=values)}) group by label"


@query(
    "findings_or_first",
    f"""select coalesce(a.label, b.label) as label, case when a.label is not null then 'first' else 'matcher-1' end as matcher, coalesce(a.hits, b.hits) as hits
        from ({_hit_list("case when contains(line, 'treaty') then ['treaty'] else [] end")}) a
        full join ({_hit_list("case when contains(line, 'harbour') then ['harbour'] else [] end")}) b on a.label = b.label""",
)
def findings_or_first(spark, sf):
    rule = Rule("r", requests=[Request(matchers=[Matcher(name="first", words=["treaty"]), Matcher(words=["harbour"])])])
    f = scan.scan(_docs(spark, sf), [rule])
    return f.select("label", F.explode("matches").alias("matcher", "h")).select("label", "matcher", _hits(F.col("h")).alias("hits"))


@query("findings_and_doc", "select doc_id::varchar as label from documents where contains(text, 'treaty') and contains(text, 'harbour') and not contains(text, 'budget')")
def findings_and_doc(spark, sf):
    ms = [Matcher(words=["treaty"]), Matcher(words=["harbour"]), Matcher(words=["budget"], negative=True)]
    return scan.scan(_docs(spark, sf), [Rule("r", requests=[Request(condition="and", matchers=ms)])]).select("label")


@query("findings_extract_only", f"select label, hits as extracts from ({_hit_list(f'''regexp_extract_all(line, '{CASES}', 1)''')})")
def findings_extract_only(spark, sf):
    return scan.scan(_docs(spark, sf), [adhoc(CASES, group=1)]).select("label", _hits(F.col("extracts")).alias("extracts"))


@query("findings_matcher_gate", f"select label, hits as extracts from ({_hit_list(f'''regexp_extract_all(line, '{CASES}', 1)''')}) where label in (select doc_id::varchar from documents where contains(text, 'treaty'))")
def findings_matcher_gate(spark, sf):
    rule = Rule("r", requests=[Request(matchers=[Matcher(words=["treaty"])], extractors=[Extractor(regex=[CASES], group=1)])])
    return scan.scan(_docs(spark, sf), [rule]).where("extracted").select("label", _hits(F.col("extracts")).alias("extracts"))


@query(
    "findings_output_extracts",
    f"select label, string_agg(v, '|' order by v) as outputs from (select distinct label, v from ({_LINE_HITS.format(values=f'''regexp_extract_all(line, '{CASES}', 1)''')})) group by label",
)
def findings_output_extracts(spark, sf):
    inner = Extractor(name="inner", regex=[MILLIONS], group=1, internal=True)
    rule = Rule("r", requests=[Request(extractors=[Extractor(name="n", regex=[CASES], group=1), inner])])
    return scan.scan(_docs(spark, sf), [rule]).select("label", _joined(F.col("output_extracts")).alias("outputs"))


_NAMED = "select label, string_agg(v, '|' order by v) as named from ({hits}) group by label"
_OF_CASES, _OF_MILLIONS = (_LINE_HITS.format(values=f"regexp_extract_all(line, '{p}', 1)") for p in (CASES, MILLIONS))


@query("findings_named_extracts", _NAMED.format(hits=f"{_OF_CASES} union all select * from ({_OF_MILLIONS}) where label not in (select label from ({_OF_CASES}))"))
def findings_named_extracts(spark, sf):
    # Where the later one found nothing, the earlier one's values stay.
    twice = [Extractor(name="n", regex=[MILLIONS], group=1), Extractor(name="n", regex=[CASES], group=1)]
    f = scan.scan(_docs(spark, sf), [Rule("r", requests=[Request(extractors=twice)])])
    return f.select("label", _joined(F.element_at("named_extracts", "n")).alias("named"))


PACK = [
    Rule("cases", "Cases", "high", tags=["numbers", "en"], requests=[Request(extractors=[Extractor(name="n", regex=[CASES], group=1)])]),
    Rule("treaty", "Treaty", "low", tags=["words"], requests=[Request(matchers=[Matcher(name="w", words=["treaty", "harbour"])])]),
    Rule("money", "Money", "medium", tags=["numbers"], requests=[Request(condition="and", matchers=[Matcher("regex", regex=[MILLIONS]), Matcher("regex", name="year", regex=[r"In (19|20)\d\d"])])]),
    Rule("long", "Long", "info", requests=[Request(matchers=[Matcher("dsl", dsl=["len(raw) > 3000"])])]),
]
_PACK_SQL = f"""
    select doc_id::varchar as label, 'cases' as template_id, 'high' as severity from documents where regexp_matches(text, '{CASES}') and doc_id::varchar in (select label from ({LABEL_LINES}) where regexp_matches(line, '{CASES}'))
    union all select doc_id::varchar, 'treaty', 'low' from documents where contains(text, 'treaty') or contains(text, 'harbour')
    union all select label, 'money', 'medium' from ({LABEL_LINES}) group by label having bool_or(regexp_matches(line, '{MILLIONS}')) and bool_or(regexp_matches(line, 'In (19|20)\\d\\d'))
    union all select doc_id::varchar, 'long', 'info' from documents where strlen(text) > 3000"""


@query("findings_multi_rule", _PACK_SQL)
def findings_multi_rule(spark, sf):
    return scan.scan(_docs(spark, sf), PACK).select("label", "template_id", "severity")


@query("findings_multi_rule_automaton", _PACK_SQL)
def findings_multi_rule_automaton(spark, sf):
    return scan.scan(_docs(spark, sf), PACK, engine="arrow").select("label", "template_id", "severity")


# The rules table interpreted by SQL: what each matcher and extractor finds, then what each request makes of it.
_RULE_PACK_SQL = f"""
    with docs as (select label, raw_line as raw from {RAW} where raw_line <> ''),
    lines as (select label, line, lower(line) as low, hex(line) as digits from ({RAW_LINES})),
    q as (select rule_id, coalesce(severity, '') as severity, unnest(requests) as r, generate_subscripts(requests, 1) as k from rules),
    ms as (select rule_id, k, unnest(r.matchers) as m, generate_subscripts(r.matchers, 1) as j from q),
    es as (select rule_id, k, unnest(r.extractors) as e, generate_subscripts(r.extractors, 1) as j from q),
    in_lines as (
        select label, rule_id, k, j from lines, ms where m.matcher_type = 'word' and len(m.words) > 0
            and len(list_filter(m.words, lambda w: contains(case when coalesce(m.case_insensitive, false) then low else line end, case when coalesce(m.case_insensitive, false) then lower(w) else w end)))
                >= case when m.words_condition = 'and' then len(m.words) else 1 end
        union all select label, rule_id, k, j from lines, ms where m.matcher_type = 'binary' and len(m.hex_patterns) > 0
            and len(list_filter(m.hex_patterns, lambda x: contains(digits, upper(x)) and regexp_matches(digits, '^(..)*' || upper(x)))) >= case when m.words_condition = 'and' then len(m.hex_patterns) else 1 end
        union all select label, rule_id, k, j from lines, (select rule_id, k, j, unnest(m.regexes) as p from ms where m.matcher_type = 'regex') where regexp_matches(line, p)
        union all select label, rule_id, k, j from docs, ms where m.matcher_type = 'size' and list_contains(m.sizes, strlen(raw))
        union all select label, rule_id, k, j from docs, ms where m.matcher_type = 'dsl' and len(m.dsl) > 0
            and len(list_filter(m.dsl, lambda x: strlen(raw) > regexp_extract(x, '> ([0-9]+)$', 1)::bigint)) >= case when m.words_condition = 'and' then len(m.dsl) else 1 end),
    present as (select distinct label, rule_id, k, j from in_lines),
    positive as (select label, rule_id, k, count(*) as n from present join ms using (rule_id, k, j) where not coalesce(m.negative, false) group by all),
    negated as (select label, rule_id, k, count(*) as n from present join ms using (rule_id, k, j) where m.negative group by all),
    sizes as (select rule_id, k, count(*) as n, count(*) filter (coalesce(m.negative, false)) as n_negative from ms group by all),
    found as (select label, rule_id, k, sum(n)::int as n_extracts, bool_or(shown) as extracted from (
        select label, rule_id, k, case when coalesce(e.capture_group, 0) = 0 then len(regexp_extract_all(line, p)) else len(regexp_extract_all(line, p, 1)) end as n, not coalesce(e.is_internal, false) as shown
        from lines, (select rule_id, k, e, unnest(e.regexes) as p from es where e.extractor_type = 'regex') where regexp_matches(line, p)) group by all),
    every as (
        select label, rule_id, k, coalesce(s.n, 0) as n_matchers, coalesce(p.n, 0) + coalesce(s.n_negative, 0) - coalesce(g.n, 0) as n_hold from docs cross join q left join sizes s using (rule_id, k)
            left join positive p using (label, rule_id, k) left join negated g using (label, rule_id, k) where coalesce(len(r.matchers), 0) + coalesce(len(r.extractors), 0) > 0),
    told as (
        select label, rule_id, k, n_matchers, n_matchers > 0 and n_hold >= case when q.r.matchers_condition = 'and' then n_matchers else 1 end as matched,
               coalesce(f.extracted, false) as extracted, coalesce(f.n_extracts, 0) as n_extracts, severity
        from every join q using (rule_id, k) left join found f using (label, rule_id, k))
    select label, rule_id as template_id, severity, matched, extracted, n_extracts from told where matched or n_matchers = 0 and extracted"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the rules table over all raw lines, in one pass."""
    rules = from_table(table(spark, sf, "rules"))
    f = scan.scan(_matches(spark, sf), rules)
    return f.select("label", "template_id", "severity", "matched", "extracted", F.size("extracts").alias("n_extracts"))


QUERIES["findings_rule_pack"], SQL["findings_rule_pack"] = flagship, _RULE_PACK_SQL


@query("event_fanout", f"select template_id, label as path, case template_id when 'cases' then null when 'treaty' then 'w' when 'long' then null else n end as matcher_name, case when template_id = 'cases' then 'n' end as extractor_name from ({_PACK_SQL}) left join (select 'money' as t, unnest(['matcher-0', 'year']) as n) on template_id = t")
def event_fanout(spark, sf):
    return reports.fan_out(scan.scan(_docs(spark, sf), PACK)).select("template_id", "path", "matcher_name", "extractor_name")


def _merged_sql() -> str:
    def part(word: str, pattern: str) -> str:
        words = _hit_list(f"case when contains(line, '{word}') then ['{word}'] else [] end")
        found = _LINE_HITS.format(values=f"regexp_extract_all(line, '{pattern}', 1)")
        return f"""select w.label, w.hits, list_transform(list_sort(e.vs), lambda x: x) as vs, list_distinct(e.vs) as outs from ({words}) w
            left join (select label, list(v) as vs from ({found}) group by label) e on w.label = e.label"""

    both = f"select * from ({part('treaty', CASES)}) union all select * from ({part('budget', MILLIONS)})"
    hits = "string_agg(hits, '|')"
    return f"""select label, 'Two' as template_name, 'low' as severity, true as matched, count(vs) > 0 as extracted,
            array_to_string(list_sort(string_split({hits}, '|')), '|') as matches, array_to_string(list_sort(flatten(list(vs) filter (vs is not null))), '|') as named,
            array_to_string(list_sort(flatten(list(outs) filter (outs is not null))), '|') as outputs
        from ({both}) group by label"""


@query("findings_merge_requests", _merged_sql())
def findings_merge_requests(spark, sf):
    request = lambda word, pattern: Request(matchers=[Matcher(name="w", words=[word])], extractors=[Extractor(name="n", regex=[pattern], group=1)])
    f = reports.merge_rules(scan.scan(_docs(spark, sf), [Rule("two", "Two", "low", requests=[request("treaty", CASES), request("budget", MILLIONS)])]))
    hits = F.transform(F.element_at("matches", "w"), lambda h: F.concat_ws(":", h["line"], h["byte_offset"], h["value"]))
    named = F.coalesce(F.try_element_at("named_extracts", F.lit("n")), F.array().cast("array<string>"))
    listed = lambda c: F.when(F.size(c) > 0, _joined(c))
    return f.select("label", "template_name", "severity", "matched", "extracted", _joined(hits).alias("matches"), listed(named).alias("named"), listed(F.col("output_extracts")).alias("outputs"))


# ---- pre-filters ------------------------------------------------------------------

LITERALS = sorted({x for q in PACK[:3] for x in request_literals(q.requests[0]) or ()})


@query("prefilter_lines", f"select doc_id, count(*) as n_lines, count(*) filter ({' or '.join(f'''contains(lower(line), '{x}')''' for x in LITERALS)}) as n_may_match from ({DOC_LINES}) group by doc_id")
def prefilter_lines(spark, sf):
    may = F.lit(False)
    for x in LITERALS:
        may = may | text.contains_folded(F.col("line"), x)
    return _lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(may).alias("n_may_match"))


@query("prefilter_candidates", f"select literal, count(*) as n_lines from ({DOC_LINES}), (select unnest({LITERALS!r}) as literal) where contains(lower(line), literal) group by literal")
def prefilter_candidates(spark, sf):
    low = regex.folded(F.col("line"))
    hit = F.filter(F.array(*[F.lit(x) for x in LITERALS]), lambda x: F.contains(low, x))
    return _lines(spark, sf).select(F.explode(hit).alias("literal")).groupBy("literal").agg(F.count("*").alias("n_lines"))


@query("prefilter_off_equals_on", _PACK_SQL)
def prefilter_off(spark, sf):
    return scan.scan(_docs(spark, sf), PACK, guards=False).select("label", "template_id", "severity")


# ---- paths and contents -------------------------------------------------------------

_PATHS = "(select distinct file_path as path from findings where file_path is not null)"
_EXT = "regexp_extract(regexp_extract(path, '[^/\\\\]*$'), '\\.[^.]*$')"
_SLASH = "regexp_extract(path, '^.*[/\\\\]')"


def _paths(spark, sf) -> DataFrame:
    return table(spark, sf, "findings").select(F.col("file_path").alias("path")).where("path is not null").distinct()


@query("path_parts", f"select path, {_EXT} as ext, regexp_extract(path, '[^/\\\\]*$') as base, {_SLASH} as folder from {_PATHS}")
def path_parts(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("path", paths.extension(p).alias("ext"), paths.base(p).alias("base"), paths.folder(p).alias("folder"))


@query("path_extensions", f"select path from {_PATHS} where {_EXT} in ('.py', '.go')")
def path_extensions(spark, sf):
    return _paths(spark, sf).where(paths.selected(F.col("path"), [".py", "go"], []))


@query("path_all_or_listed", f"select path from {_PATHS} where {_EXT} = '.lock' or {_EXT} not in ({', '.join(map(repr, [*paths.MEDIA, *paths.EXECUTABLE, *paths.DOCUMENT, *paths.OTHER, *paths.ARCHIVE, '.go']))}) and not regexp_matches(path, '^[/\\\\]*legacy[/\\\\]')")
def path_all_or_listed(spark, sf):
    return _paths(spark, sf).where(paths.selected(F.col("path"), ["all", ".lock"], [".go", "legacy"]))


@query("path_denied", f"select path from {_PATHS} where regexp_matches(path, '^[/\\\\]*infra[/\\\\]') or regexp_matches(path, '^[/\\\\]*app[/\\\\]+user[/\\\\]') or {_EXT} = '.ts'")
def path_denied(spark, sf):
    return _paths(spark, sf).where(paths.denied(F.col("path"), ["infra/", "app/user", ".ts"]))


@query("path_skip_folders", f"select path from {_PATHS} where not list_has_any(string_split_regex({_SLASH}, '[/\\\\]'), ['cache', 'page', 'node_modules'])")
def path_skip_folders(spark, sf):
    skip = paths.Filters(skipped_folders=("cache", "page", "node_modules"))
    return _paths(spark, sf).where(~paths.in_skipped_folder(F.col("path"), skip))


@query("path_glob", f"select path from {_PATHS} where regexp_matches(path, '^src/(.*/)?[^/]*_[0-9a-f]+\\.(py|go)$')")
def path_glob(spark, sf):
    return _paths(spark, sf).where(F.col("path").rlike(regex.glob_to_regex("src/**/*_*.{py,go}")) & F.col("path").rlike("_[0-9a-f]+\\.[a-z]+$"))


@query("path_media", f"select path, {_EXT} in ({', '.join(map(repr, [*paths.MEDIA, '.py', '.go']))}) as media from {_PATHS}")
def path_media(spark, sf):
    return _paths(spark, sf).select("path", paths.always_denied(F.col("path"), paths.Filters(media=(*paths.MEDIA, ".py", ".go"))).alias("media"))


@query("path_known_text", f"select path, lower({_EXT}) in ({', '.join(map(repr, paths.KNOWN_TEXT))}) as known from {_PATHS}")
def path_known_text(spark, sf):
    return _paths(spark, sf).select("path", paths.known_text(F.col("path")).alias("known"))


@query("ascii_fold", "select doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as folded from documents")
def ascii_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.ascii_lower(F.col("text")).cast("binary")).alias("folded"))


_HEX = "hex(payload[1:1024])"
_BYTES = f"list_transform(range(0, strlen({_HEX}) // 2), lambda i: substr({_HEX}, i * 2 + 1, 2))"


@query(
    "text_sniff",
    f"""select block_id, case when octet_length(payload) = 0 then true else not list_contains(b, '00')
            and len(list_filter(b, lambda x: x < '20' and x not in ('09', '0A', '0D'))) / len(b) < 0.3 end as is_text
        from (select block_id, payload, {_BYTES} as b from (select block_id, payload from blocks where payload is not null))""",
)
def text_sniff(spark, sf):
    return table(spark, sf, "blocks").where("payload is not null").select("block_id", text.looks_like_text(F.col("payload")).alias("is_text"))


@query("scan_files_text", f"select 'f' || block_id || '.bin' as path from blocks join ({SQL['text_sniff']}) using (block_id) where is_text and octet_length(payload) between 1 and 30000 and contains(payload::varchar, 'token')")
def scan_files_text(spark, sf):
    """Files taken by a request that wants text of a limited size: unknown extensions are judged by their first bytes."""
    files = table(spark, sf, "blocks").select(F.format_string("f%d.bin", "block_id").alias("path"), F.col("payload").alias("content"))
    rule = Rule("r", requests=[Request(max_size=30000, matchers=[Matcher(words=["token"])])])
    return scan.scan_files(files, [rule]).select("path")


@query("mime_sniff", "select block_id, hex(payload[1:4]) = '504B0304' or hex(payload[1:3]) = '1F8B08' as is_archive from blocks where payload is not null")
def mime_sniff(spark, sf):
    return table(spark, sf, "blocks").where("payload is not null").select("block_id", text.is_mime(F.col("payload"), ["application/zip", "application/gzip"]).alias("is_archive"))


# ---- windows --------------------------------------------------------------------------

_WINDOWS_SQL = """
    select block_id, w::int as window_no, (w * 31744)::bigint as window_start, least(n - w * 31744, 32768)::bigint as n_bytes,
           (case when w * 31744 + 32768 >= n then n else (w + 1) * 31744 end)::bigint as owned_end
    from (select block_id, octet_length(payload) as n, unnest(range(0, greatest(0, octet_length(payload) - 1024 - 1) // 31744 + 1)) as w from blocks where octet_length(payload) > 0)"""


@query("block_windows", _WINDOWS_SQL)
def block_windows(spark, sf):
    w = windows.explode_windows(table(spark, sf, "blocks").select("block_id", "payload"), "payload", 32768, 1024)
    return w.select("block_id", "window_no", F.col("window_start").cast("long").alias("window_start"), F.octet_length("payload").cast("long").alias("n_bytes"), F.col("owned_end").cast("long").alias("owned_end"))


@query("block_dedupe_counts", "select block_id, n from (select block_id, ((strlen(payload::varchar) - strlen(replace(payload::varchar, 'password', ''))) // 8)::bigint as n from blocks where payload is not null) where n > 0")
def block_dedupe_counts(spark, sf):
    return windows.window_hits(table(spark, sf, "blocks"), "payload", "password", ["block_id"], 1000, 20).groupBy("block_id").agg(F.count("*").alias("n"))


@query("block_findings", "select block_id, ((strlen(payload::varchar) - strlen(replace(payload::varchar, 'token', ''))) // 5)::int as n_extracts from blocks where contains(payload::varchar, 'token')")
def block_findings(spark, sf):
    f = windows.scan_blocks(table(spark, sf, "blocks"), [adhoc("token")], "block_label", "payload", "base_address", keep=["block_id"])
    return f.select("block_id", F.size("extracts").alias("n_extracts"))


# A payload as its bytes' hexadecimal digits with a blank behind each, so that a needle is found at whole bytes only.
_PAYLOAD_HEX = "(select block_id, coalesce(base_address, 0) as base, regexp_replace(hex(payload), '(..)', '\\1 ', 'g') as h from blocks where octet_length(payload) > 0)"


def _spots(value: str, needle: bytes) -> str:
    """SQL of the positions of a byte string that doesn't overlap itself."""
    x = "".join(f"{b:02X} " for b in needle)
    parts = f"select block_id, base, unnest(p) as part, generate_subscripts(p, 1) as i, len(p) as n from (select block_id, base, string_split(h, '{x}') as p from {_PAYLOAD_HEX})"
    return f"select block_id, base, '{value}' as v, i < n as hit, ((sum(length(part) + {len(x)}) over (partition by block_id order by i) - {len(x)}) // 3)::bigint as spot from ({parts})"


def _spots_sql(needles: list[tuple[str, bytes]], every: bool) -> str:
    found = "select * from (" + " union all ".join(_spots(v, x) for v, x in needles) + ") where hit"
    all_of = f"where block_id in (select block_id from ({found}) group by block_id having count(distinct v) = {len(needles)})" if every else ""
    return f"select block_id, (base + spot)::varchar || ':' || v as hit from ({found}) {all_of}"


def _block_hits(spark, sf, m: Matcher) -> DataFrame:
    f = windows.scan_blocks(table(spark, sf, "blocks"), [Rule("r", requests=[Request(matchers=[m])])], "block_label", "payload", "base_address", 1000, 100, keep=["block_id"])
    hits = f.select("block_id", F.explode("matches").alias("name", "h")).select("block_id", F.explode("h").alias("h"))
    return hits.select("block_id", F.concat_ws(":", F.col("h.byte_offset").cast("string"), "h.value").alias("hit"))


@query("block_word_hits", _spots_sql([("key", b"key"), ("token", b"token")], True))
def block_word_hits(spark, sf):
    return _block_hits(spark, sf, Matcher(words=["key", "token"], condition="and"))


@query("block_binary_hits", _spots_sql([("3d22", b'="'), ("0d0a", b"\r\n")], False))
def block_binary_hits(spark, sf):
    return _block_hits(spark, sf, Matcher("binary", binary=["3d22", "0d0a"], match_all=True))


# ---- reports ----------------------------------------------------------------------------


@query(
    "severity_histogram",
    "select coalesce(severity, 'unknown') as severity, coalesce(nullif(list_position(['critical', 'high', 'medium', 'low', 'info'], severity), 0), 6)::int as severity_rank, count(*) as n_findings from findings group by all",
)
def severity_histogram(spark, sf):
    return reports.severity_histogram(table(spark, sf, "findings")).select("severity", "severity_rank", "n_findings")


@query(
    "human_sizes",
    """select run_id, case when n_bytes >= 1073741824 then format('{:,.1f} GB', n_bytes / 1073741824.0) when n_bytes >= 1048576 then format('{:,.1f} MB', n_bytes / 1048576.0)
              when n_bytes >= 1024 then format('{:,.1f} KB', n_bytes / 1024.0) else format('{:,.1f} B', n_bytes::double) end as size from (select distinct * from scan_stats) where n_bytes is not null""",
)
def human_sizes(spark, sf):
    s = table(spark, sf, "scan_stats").distinct().where("n_bytes is not null")
    return s.select("run_id", paths.size_text(F.col("n_bytes")).alias("size"))


@query("rule_choice", "select rule_id from rules where severity in ('high', 'critical') and (list_contains(tags, 'pii') or list_contains(tags, 'cloud')) and not list_contains(tags, 'noisy')")
def rule_choice(spark, sf):
    rules = choose(from_table(table(spark, sf, "rules")), tags=["pii", "cloud"], severities=["high", "critical"], exclude_tags=["noisy"])
    return spark.createDataFrame([(r.id,) for r in rules], "rule_id string")


@query(
    "rule_compile",
    """select rule_id, name, severity, tags, n_requests, count(r)::int as n_used, coalesce(sum(len(r.matchers)), 0)::int as n_matchers, coalesce(sum(len(r.extractors)), 0)::int as n_extractors,
              count(*) filter (r.matchers_condition = 'and')::int as n_every, coalesce(max(r.max_size), -1)::bigint as max_size, count(*) filter (r.mimetype)::int as n_mimetype
       from (select rule_id, coalesce(rule_name, '') as name, coalesce(severity, '') as severity, coalesce(array_to_string(tags, ','), '') as tags, len(requests)::int as n_requests, unnest(requests) as r from rules) group by all""",
)
def rule_compile(spark, sf):
    """What the rules of a table are compiled to."""
    total = lambda r, f: sum(f(q) for q in r.requests)
    rows = [
        (r.id, r.name, r.severity, ",".join(r.tags), len(r.requests), len(r.requests), total(r, lambda q: len(q.matchers)), total(r, lambda q: len(q.extractors)),
         total(r, lambda q: q.condition == "and"), max((q.max_size for q in r.requests if q.max_size is not None), default=-1), total(r, lambda q: q.mimetype))
        for r in from_table(table(spark, sf, "rules"))
    ]
    return spark.createDataFrame(rows, "rule_id string, name string, severity string, tags string, n_requests int, n_used int, n_matchers int, n_extractors int, n_every int, max_size long, n_mimetype int")


@query("rule_groups", "select group_key, count(*) as n_requests from (select case when list_contains(x.extensions, 'all') then 'all' else array_to_string(list_sort(x.extensions), ',') end as group_key from (select unnest(requests) as x from rules)) group by group_key")
def rule_groups(spark, sf):
    g = grouped(from_table(table(spark, sf, "rules")))
    return spark.createDataFrame([(k, len(v)) for k, v in g.items()], "group_key string, n_requests long")


@query(
    "baseline_diff",
    """select f.finding_id from findings f where batch_no >= 12 and not exists
       (select 1 from findings b where b.batch_no < 12 and b.template_id is not distinct from f.template_id and b.file_path is not distinct from f.file_path)""",
)
def baseline_diff(spark, sf):
    f = table(spark, sf, "findings").select("finding_id", "batch_no", "template_id", "file_path")
    return reports.new_findings(f.where("batch_no >= 12"), f.where("batch_no < 12"), ["template_id", "file_path"]).select("finding_id")


@query("scan_statistics", f"select (select count(*) from documents)::bigint as files, (select sum(strlen(text)) from documents)::bigint as bytes, (select count(*) from ({_PACK_SQL}))::bigint as findings, 4 as rules")
def scan_statistics(spark, sf):
    d = _docs(spark, sf)
    return reports.statistics(d, "content", scan.scan(d, PACK), len(PACK))


@query(
    "run_statistics",
    "select sum(n_files)::bigint as files, sum(coalesce(n_bytes, 0))::bigint as bytes, sum(n_findings)::bigint as findings, max(n_rules) as rules from (select distinct * from scan_stats)",
)
def run_statistics(spark, sf):
    s = table(spark, sf, "scan_stats").distinct()
    return s.agg(F.sum("n_files").alias("files"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("bytes"), F.sum("n_findings").alias("findings"), F.max("n_rules").alias("rules"))


@query(
    "findings_json",
    f"""select label, template_id, len(string_split(hits, '|'))::int as n_extracts, regexp_extract(hits, '^([0-9]+):', 1)::int as first_line from
        (select label, 'cases' as template_id, hits from ({_hit_list(f'''regexp_extract_all(line, '{CASES}', 1)''')}))""",
)
def findings_json(spark, sf):
    j = reports.as_json(scan.scan(_docs(spark, sf), PACK[:1]))
    back = F.from_json("json", "`template-id` string, file string, extracts array<struct<value:string,line:int,offset:long>>")
    return j.select(back.alias("j")).select(F.col("j.file").alias("label"), F.col("j.`template-id`").alias("template_id"), F.size("j.extracts").alias("n_extracts"), F.col("j.extracts")[0]["line"].alias("first_line"))


@query(
    "findings_text",
    f"select label, '[Cases] [high] [cases] ' || label || chr(10) || body as report from (select label, string_agg('   [L' || line_no || '] ' || v, chr(10) order by line_no, k) as body from (select label, line_no, unnest(vs) as v, generate_subscripts(vs, 1) as k from (select label, line_no, regexp_extract_all(line, '{CASES}', 1) as vs from ({LABEL_LINES}))) group by label)",
)
def findings_text(spark, sf):
    f = scan.scan(_docs(spark, sf), PACK[:1])
    return reports.as_lines(f).select("label", F.col("text").alias("report"))


# ---- streams and files ---------------------------------------------------------------------


def _chunks(df: DataFrame, label: str, data: Column, size: int) -> DataFrame:
    """The bytes of ``data`` in chunks of ``size``, the last one marked."""
    n = F.octet_length("data")
    rows = df.select(F.col(label).cast("string").alias("label"), data.alias("data")).where(n > 0)
    cut = rows.select("label", "data", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("at"))
    return cut.select("label", (F.col("at") / size).cast("int").alias("seq"), F.substring("data", F.col("at") + 1, F.lit(size)).alias("data"), (F.col("at") + size >= F.col("n")).alias("is_last"))


def _streamed(spark: SparkSession, chunks: DataFrame, operator) -> DataFrame:
    """What a streaming operator makes of chunks that lie in a folder, run until all are read."""
    source, sink, state = (scratch_path(spark, x) for x in ("chunks", "streamed", "offsets"))
    chunks.write.parquet(source)
    out = operator(spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 4).parquet(source))
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def _scattered(chunks: DataFrame) -> DataFrame:
    """A label's chunks in several files, so that a stream meets them out of order and in several micro-batches."""
    return chunks.repartition(8, "seq")


@query("stream_lines", f"select label, line_no::bigint as line_no, byte_offset, line from ({LABEL_LINES}) where line <> ''")
def stream_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return _streamed(spark, _scattered(_chunks(d, "doc_id", F.col("b"), 300)), writers.assemble_lines).select("label", "line_no", "byte_offset", "line")


@query("stream_windows", "select block_id::varchar as label, window_start, owned_end, n_bytes from (" + _WINDOWS_SQL + ")")
def stream_windows(spark, sf):
    c = _scattered(_chunks(table(spark, sf, "blocks"), "block_id", F.col("payload"), 5000))
    w = _streamed(spark, c, lambda s: writers.assemble_windows(s, 32768, 1024))
    return w.select("label", "window_start", "owned_end", F.octet_length("content").cast("long").alias("n_bytes"))


@query("stream_line_findings", f"select label, line_no::bigint as line_no, byte_offset, len(regexp_extract_all(line, '{CASES}', 1))::int as n_extracts from ({LABEL_LINES}) where regexp_matches(line, '{CASES}')")
def stream_line_findings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    f = _streamed(spark, _scattered(_chunks(d, "doc_id", F.col("b"), 400)), lambda s: writers.scan_line_stream(s, PACK[:1]).select("label", "line_no", "byte_offset", F.size("extracts").alias("n_extracts")))
    return f


@query("stream_block_findings", "select block_id::varchar as label, ((strlen(payload::varchar) - strlen(replace(payload::varchar, 'token', ''))) // 5)::bigint as n from blocks where contains(payload::varchar, 'token')")
def stream_block_findings(spark, sf):
    c = _scattered(_chunks(table(spark, sf, "blocks"), "block_id", F.col("payload"), 5000))
    f = _streamed(spark, c, lambda s: writers.scan_block_stream(s, [adhoc("token")], 4096, 64).select("label", F.size("extracts").cast("long").alias("n")))
    return f.groupBy("label").agg(F.sum("n").alias("n"))


#: Documents of an archive on average: far below the entries that are taken of one.
PACKED = 2000
_PACKS = f"(select greatest(8, ceil(count(*) / {PACKED}))::bigint from documents)"


@query(
    "archive_entries",
    f"""select 'pack-' || (doc_id % {_PACKS}) || ext || ':' || doc_id || '.txt' as path, strlen(text)::int as n_bytes
        from documents, (select unnest(['.zip', '.tar', '.tar.gz']) as ext) where text <> ''""",
)
def archive_entries(spark, sf):
    """Entries of archives made of all documents that have a text: zip, tar and gzipped tar."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    packs = max(8, -(-docs.count() // PACKED))

    def pack(key, pdf):
        import gzip

        import pandas as pd

        z, t = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(z, "w") as zf, tarfile.open(fileobj=t, mode="w") as tf:
            for r in pdf.itertuples():
                data, name = r.text.encode(), f"{r.doc_id}.txt"
                zf.writestr(name, data)
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tf.addfile(info, io.BytesIO(data))
        name = f"pack-{key[0]}"
        rows = [(f"{name}.zip", z.getvalue()), (f"{name}.tar", t.getvalue()), (f"{name}.tar.gz", gzip.compress(t.getvalue()))]
        return pd.DataFrame(rows, columns=["path", "content"])

    made = docs.where("text <> ''").groupBy(F.pmod("doc_id", F.lit(packs)).alias("pack")).applyInPandas(pack, "path string, content binary")
    return sources.expand_archives(made).select("path", F.octet_length("content").alias("n_bytes"))


_TREE = "'p' || (doc_id % 7) || '/' || (case when doc_id % 3 = 0 then '.hidden/' else '' end) || (case when doc_id % 2 = 0 then '.' else '_' end) || doc_id || '.txt'"


@query("folder_findings", f"select path, outputs from (select {_TREE} as path, doc_id::varchar as label from documents) join ({SQL['findings_output_extracts']}) using (label)")
def folder_findings(spark, sf):
    """Findings over all documents, written as a tree of files with hidden names below the shared folder, listed and read again."""
    docs = table(spark, sf, "documents").where("text <> ''")
    root = scratch_path(spark, "tree")
    tree = docs.select(F.expr(_TREE).alias("path"), F.encode("text", "UTF-8").alias("content"))
    sources.write_files(spread(tree, "path"), root).agg(F.sum("size")).collect()
    found = scan.scan_files(sources.corpus(spark, root), [adhoc(CASES, group=1)])
    return found.select(F.substr("path", F.lit(len(root) + 2)).alias("path"), _joined(F.col("output_extracts")).alias("outputs"))


QUERIES.update(P3_QUERIES)
SQL.update(P3_SQL)
