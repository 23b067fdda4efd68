"""Rule packs over documents: every rule in one pass, findings without a shuffle.

``native`` builds the pack into Catalyst expressions, guarded by the literals
that a rule needs. ``arrow`` finds all literals of a large pack at once with an
automaton in Arrow batches, after the same literals have been tested in the
JVM, and runs the patterns they point to. Both give the same raw results, one
row per document and rule that may have found something, from which the same
expressions assemble the findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex
from ..functions.paths import DEFAULTS, Filters, always_denied, in_skipped_folder, selected
from ..plans.rules import Request, Rule, request_literals
from . import match
from .lines import block_starts, pieces, without_return

#: Patterns up to which a pack is built into expressions.
NATIVE_PATTERNS = 64
#: Default bytes above which a content is left out.
MAX_BYTES = 1 << 30
#: Literals up to which documents are tested in the JVM before any other work.
GUARD_LITERALS = 200

_RAW = f"m array<{match.RESULT}>, e array<{match.RESULT}>"


def _requests(rules: list[Rule]) -> list[tuple[Rule, Request]]:
    return [(r, q) for r in rules for q in r.requests if q.matchers or q.extractors]


def _meta(rules: list[Rule], compat_negative: bool) -> Column:
    """What assembly needs to know of each request, as one literal array."""
    text = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    flags = lambda xs: F.array(*[F.lit(bool(x)) for x in xs]) if xs else F.array().cast("array<boolean>")
    out = []
    for r, q in _requests(rules):
        out.append(
            F.struct(
                F.lit(r.id).alias("template_id"), F.lit(r.name).alias("template_name"), F.lit(r.severity).alias("severity"), F.lit(q.condition == "and").alias("every"),
                text([m.name or f"matcher-{i}" for i, m in enumerate(q.matchers)]).alias("names"), flags([m.negative for m in q.matchers]).alias("negative"),
                flags([compat_negative and m.negative and m.type == "word" for m in q.matchers]).alias("always"),
                text([e.name or "" for e in q.extractors]).alias("extract_names"), flags([e.internal for e in q.extractors]).alias("internal"),
            )
        )
    return F.array(*out)


def assemble(raw: DataFrame, rules: list[Rule], keep: list[str], compat_negative: bool = False) -> DataFrame:
    """Findings of raw results (``rule`` index, ``m`` and ``e`` result arrays).

    Under ``or`` only the first matcher that holds is reported, under ``and``
    all must hold, on any lines. A negative matcher holds if it has no hit in
    the document; ``compat_negative`` lets negative word matchers always hold.
    Matches of one name are joined. All extracts are listed; the output
    extracts are the distinct values of extractors that aren't internal, in
    order; of several extractors of one name the last that found something
    gives the named extracts. ``request`` numbers the pack's requests. A rule with matchers needs one that holds, one
    without needs an output extract.
    """
    z = raw.withColumn("r", F.element_at(_meta(rules, compat_negative), F.col("rule") + 1))
    verdicts = F.zip_with("m", "r.negative", lambda x, neg: x["has"] != neg)
    if compat_negative:
        verdicts = F.zip_with(verdicts, "r.always", lambda x, always: x | always)
    z = z.withColumn("verdicts", verdicts)
    z = z.withColumn("matched", (F.size("m") > 0) & F.when(F.col("r.every"), F.forall("verdicts", lambda x: x)).otherwise(F.exists("verdicts", lambda x: x)))
    # Most findings of sizes, expressions and negations have no hits: nothing further is made of them.
    some = lambda c: F.exists(c, lambda x: F.size(x["hits"]) > 0)
    z = z.where(F.col("matched") | (F.size("m") == 0) & some("e")).withColumn("found", some("m")).withColumn("taken", some("e"))
    where = lambda test, c, kind: F.when(F.col(test), c).otherwise(F.lit(None).cast(kind))
    hits = f"array<{match.HIT}>"
    ms = F.arrays_zip(F.col("m.hits").alias("hits"), F.col("r.names").alias("name"), F.col("r.negative").alias("neg"), F.col("verdicts").alias("holds"))
    holds = F.transform(F.filter(ms, lambda x: x["holds"]), lambda x: F.named_struct(F.lit("name"), x["name"], F.lit("hits"), F.when(x["neg"], F.array().cast(hits)).otherwise(x["hits"])))
    z = z.withColumn("holds", where("found", holds, f"array<struct<name:string,hits:{hits}>>"))
    es = F.filter(F.arrays_zip(F.col("e.hits").alias("hits"), F.col("r.extract_names").alias("name"), F.col("r.internal").alias("internal")), lambda x: F.size(x["hits"]) > 0)
    z = z.withColumn("es", where("taken", es, f"array<struct<hits:{hits},name:string,internal:boolean>>"))
    output = F.array_distinct(F.flatten(F.transform(F.filter("es", lambda x: ~x["internal"]), lambda x: x["hits"]["value"])))
    z = z.withColumn("output_extracts", F.coalesce(where("taken", output, "array<string>"), F.array().cast("array<string>"))).where(F.col("matched") | (F.size("output_extracts") > 0))
    chosen = F.filter(F.when(F.col("r.every"), F.col("holds")).otherwise(F.slice("holds", 1, 1)), lambda x: F.size(x["hits"]) > 0)
    z = z.withColumn("chosen", where("found", chosen, f"array<struct<name:string,hits:{hits}>>"))
    named = F.filter("es", lambda x: (x["name"] != "") & ~x["internal"])
    z = z.withColumn("named", where("taken", named, f"array<struct<hits:{hits},name:string,internal:boolean>>"))
    matches = F.map_from_entries(F.transform(F.array_distinct(F.col("chosen.name")), lambda n: F.struct(n, F.flatten(F.transform(F.filter("chosen", lambda x: x["name"] == n), lambda x: x["hits"])))))
    extracts = F.map_from_entries(F.transform(F.array_distinct(F.col("named.name")), lambda n: F.struct(n, F.element_at(F.filter("named", lambda x: x["name"] == n), -1)["hits"]["value"])))
    or_none = lambda test, c, kind: F.coalesce(where(test, c, kind), F.map_from_arrays(F.array(), F.array()).cast(kind))
    return z.select(
        *keep, "r.template_id", "r.template_name", "r.severity", F.col("rule").alias("request"), or_none("found", matches, f"map<string,{hits}>").alias("matches"),
        F.coalesce(where("taken", F.flatten(F.col("es.hits")), hits), F.array().cast(hits)).alias("extracts"),
        "matched", (F.size("output_extracts") > 0).alias("extracted"), or_none("taken", extracts, "map<string,array<string>>").alias("named_extracts"), "output_extracts",
    )


def _only_java(rules: list[Rule]) -> bool:
    """Whether some pattern can be evaluated by expressions only."""
    for _, q in _requests(rules):
        for p in (p for x in [*q.matchers, *q.extractors] for p in x.regex):
            try:
                regex.to_java(p)
            except regex.Unsupported:
                continue  # neither engine evaluates it
            try:
                regex.to_python(p)
            except regex.Unsupported:
                return True
    return False


def _event(label: Column, content: Column) -> dict[str, Column]:
    return {"raw": content, "path": label, "matched": label, "type": F.lit("file")}


def _native(docs: DataFrame, rules: list[Rule], keep: list[str], guards: bool, whole: bool = False, legacy: bool = False) -> DataFrame:
    ls, event = F.col("__lines"), _event(F.col("__label"), F.col("__content"))
    results, low = [], F.col("__low")
    for i, (_, q) in enumerate(_requests(rules)):
        empty = f"array<{match.RESULT}>"
        m = F.array(*[match.matcher(x, ls, event, legacy) for x in q.matchers]) if q.matchers else F.array().cast(empty)
        e = F.array(*[match.extractor(x, ls, event) for x in q.extractors]) if q.extractors else F.array().cast(empty)
        one = F.struct(F.lit(i).alias("rule"), m.cast(empty).alias("m"), e.cast(empty).alias("e"))
        lits = request_literals(q) if guards else None
        if lits:
            may = F.lit(False)
            for x in lits:
                may = may | F.contains(low, F.lit(x))
            one = F.when(may, one)
        results.append(one)
    # Lower case only where some test ignores case; the lines are split once for all rules.
    requests = [q for _, q in _requests(rules)]
    folds = any(m.case_insensitive for q in requests for m in q.matchers) or any(regex.literals(p) and not regex.exact_literals(p) for q in requests for x in [*q.matchers, *q.extractors] for p in x.regex)
    need_low = folds or guards and any(request_literals(q) for q in requests)
    rows = docs.withColumn("__low", regex.folded(F.col("__content")) if need_low else F.lit(None).cast("string")).withColumn("__parts", F.array("__content") if whole else pieces(F.col("__content"))).withColumn("__starts", block_starts(F.col("__parts")))
    low_of = (F.array("__low") if whole else F.split("__low", "\n", -1)) if folds else F.lit(None).cast("array<string>")
    rows = rows.withColumn("__low_parts", low_of)
    clean = F.transform("__parts", lambda raw, i: F.named_struct(F.lit("line_no"), i + 1, F.lit("line"), raw if whole else without_return(raw), F.lit("low"), F.get("__low_parts", i)))
    rows = rows.withColumn("__lines", clean)
    # One array of all rules' results per document.
    return rows.select(*keep, F.explode(F.filter(F.array(*results), lambda x: x.isNotNull())).alias("x")).select(*keep, "x.*")


class _Engine:
    """A pack's patterns and the automaton over their literals, for one Python worker."""

    def __init__(self, requests: list[Request]):
        import ahocorasick

        self.requests = requests
        self.compiled: dict[str, re.Pattern | None] = {}
        self.guards: dict[str, frozenset[str]] = {}
        # What makes a request worth a look: a literal, or a size or expression that holds.
        self.always, self.owners, self.by_slot = [], {}, []
        for i, q in enumerate(requests):
            for op in [*q.matchers, *q.extractors]:
                for p in op.regex:
                    self.pattern(p)
            self.by_slot += [i for m in q.matchers if m.type in ("size", "dsl")]
            lits = self.activators(q)
            if lits is None:
                self.always.append(i)
            for x in lits or ():
                self.owners.setdefault(x, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for x in {*self.owners, *(x for g in self.guards.values() for x in g)}:
            self.automaton.add_word(x, x)
        if len(self.automaton):
            self.automaton.make_automaton()

    def activators(self, q: Request) -> set[str] | None:
        """Literals one of which a content must hold for an operator to find anything, sizes and expressions aside; None for any content."""
        lits = request_literals(q)
        if lits is not None:
            return set(lits)
        out: set[str] = set()
        for op in q.matchers or q.extractors:
            if getattr(op, "negative", False):
                return None
            if op.type in ("size", "dsl", "kval"):
                continue
            if op.type == "word":
                per = [{w.lower()} if len(w) >= regex.MIN_LITERAL and w.isascii() else None for w in op.words]
            elif op.type == "regex":
                per = [set(self.guards[p]) or None for p in op.regex if self.compiled[p] is not None]
            else:
                raw = [bytes.fromhex(x) for x in op.binary]
                per = [{x.decode().lower()} if len(x) >= regex.MIN_LITERAL and x.isascii() else None for x in raw]
            if not all(per):
                return None
            out |= {x for p in per for x in p}
        return out

    def pattern(self, p: str) -> re.Pattern | None:
        if p not in self.compiled:
            try:
                self.compiled[p] = regex.to_python(p)
                self.guards[p] = frozenset(regex.literals(p) or ())
            except regex.Unsupported:
                self.compiled[p], self.guards[p] = None, frozenset()
        return self.compiled[p]

    def find(self, p: str, text: str, low: str, group: int = 0) -> list[str]:
        rx = self.pattern(p)
        if rx is None or group > rx.groups or self.guards[p] and not any(x in low for x in self.guards[p]):
            return []
        return [m[group] or "" for m in rx.finditer(text)]

    def present(self, low: str) -> set[str]:
        """The literals that a folded text contains, found in one pass."""
        return {x for _, x in self.automaton.iter(low)} if len(self.automaton) else set()

    def possible(self, patterns: list[str], present: set[str]) -> list[str]:
        """The patterns whose literals are present."""
        return [p for p in patterns if self.compiled[p] is not None and (not self.guards[p] or not self.guards[p].isdisjoint(present))]

    def binary(self, m) -> list[bytes]:
        return [bytes.fromhex(x) for x in m.binary]

    def candidates(self, present: set[str], asked: list[bool]) -> list[int]:
        """The requests that may find something where these literals are present and these sizes and expressions hold."""
        found = set(self.always)
        for x in present:
            found |= self.owners.get(x, frozenset())
        found.update(i for i, holds in zip(self.by_slot, asked) if holds)
        return sorted(found)


_ENGINES: dict[str, _Engine] = {}


def engine_of(requests: list[Request]) -> _Engine:
    """The engine of a pack, built once per Python worker."""
    key = repr(requests)
    if key not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[key] = _Engine(requests)
    return _ENGINES[key]


class _Results:
    """Outcomes of rules, gathered in flat lists and turned into nested Arrow arrays at once."""

    def __init__(self):
        self.values, self.lines, self.offsets, self.has = [], [], [], []
        self.hit_ends, self.row_ends = [0], [0]

    def add(self, outcomes) -> None:
        for has, hits in outcomes:
            self.has.append(has)
            for v, line, at in hits:
                self.values.append(v)
                self.lines.append(line)
                self.offsets.append(at)
            self.hit_ends.append(len(self.values))
        self.row_ends.append(len(self.has))

    def arrow(self) -> pa.Array:
        hits = pa.StructArray.from_arrays([pa.array(self.values, pa.string()), pa.array(self.lines, pa.int32()), pa.array(self.offsets, pa.int64())], names=["value", "line", "byte_offset"])
        lists = pa.ListArray.from_arrays(pa.array(self.hit_ends, pa.int32()), hits)
        results = pa.StructArray.from_arrays([pa.array(self.has, pa.bool_()), lists], names=["has", "hits"])
        return pa.ListArray.from_arrays(pa.array(self.row_ends, pa.int32()), results)


def _low(text: str) -> str:
    return text.translate({0x17F: "s", 0x212A: "k"}).lower()


def _split(content: str) -> list[tuple[int, int, str, str]]:
    out, at = [], 0
    parts = content.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    for n, raw in enumerate(parts, 1):
        line = raw[:-1] if raw.endswith("\r") else raw
        out.append((n, at, line, _low(line)))
        at += len(raw) + 1 if raw.isascii() else len(raw.encode()) + 1
    return out


def _words(m, text: str) -> list[str]:
    corpus = text.lower() if m.case_insensitive else text
    words = [w.lower() if m.case_insensitive else w for w in m.words]
    present = [w for w in words if w in corpus]
    if m.condition == "and":
        return words if words and len(present) == len(words) else []
    return present if m.match_all else present[:1]


def _bytes(m, text: str) -> list[str]:
    raw = text.encode()
    present = [x for x in m.binary if bytes.fromhex(x) in raw]
    if m.condition == "and":
        return list(m.binary) if m.binary and len(present) == len(m.binary) else []
    return present if m.match_all else present[:1]


def _arrow(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    requests = [q for _, q in _requests(rules)]
    lits = [request_literals(q) for q in requests]
    rows = docs
    flat = sorted({x for p in lits if p for x in p})
    if all(lits) and len(flat) <= GUARD_LITERALS:
        low, may = regex.folded(F.col("__content")), F.lit(False)
        for x in flat:
            may = may | F.contains(low, F.lit(x))
        rows = rows.where(may)
    # Sizes and expressions are asked natively, one array of verdicts per document.
    event = _event(F.col("__label"), F.col("__content"))
    asked = [(i, j, match.matcher(m, F.lit(None), event)["has"]) for i, q in enumerate(requests) for j, m in enumerate(q.matchers) if m.type in ("size", "dsl")]
    slots = {(i, j): k for k, (i, j, _) in enumerate(asked)}
    verdicts = F.array(*[c for *_, c in asked]) if asked else F.array().cast("array<boolean>")
    rows = rows.select(*keep, "__content", verdicts.alias("__asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = engine_of(requests)
        for b in batches:
            contents, asked_of = b.column("__content").to_pylist(), b.column("__asked").to_pylist()
            take, rule, ms, es = [], [], _Results(), _Results()
            for n, content in enumerate(contents):
                low = _low(content)
                present, raw, ls = engine.present(low), None, None
                for i in engine.candidates(present, asked_of[n]):
                    q = requests[i]
                    outcomes = []
                    for j, m in enumerate(q.matchers):
                        if (i, j) in slots:
                            outcomes.append((bool(asked_of[n][slots[i, j]]), ()))
                            continue
                        # What isn't in the document is in none of its lines.
                        if m.type == "word":
                            may = any(w.lower() in low for w in m.words)
                        elif m.type == "regex":
                            may = engine.possible(m.regex, present)
                        else:
                            raw = content.encode() if raw is None else raw
                            may = any(x in raw for x in engine.binary(m))
                        hits = ()
                        if may:
                            ls = _split(content) if ls is None else ls
                            if m.type == "word":
                                hits = [(v, k, at) for k, at, t, _ in ls for v in _words(m, t)]
                            elif m.type == "regex":
                                hits = [(v, k, at) for k, at, t, lo in ls for p in may for v in engine.find(p, t, lo)]
                            else:
                                hits = [(v, k, at) for k, at, t, _ in ls for v in _bytes(m, t)]
                        outcomes.append((bool(hits), hits))
                    extracts = []
                    for x in q.extractors:
                        may = engine.possible(x.regex, present) if x.type == "regex" else ()
                        hits = ()
                        if may:
                            ls = _split(content) if ls is None else ls
                            hits = [(v, k, at) for k, at, t, lo in ls for p in may for v in engine.find(p, t, lo, x.group)]
                        extracts.append((bool(hits), hits))
                    # Rules without any outcome and any negation can't give a finding.
                    if any(h for h, _ in outcomes) or any(h for h, _ in extracts) or any(m.negative for m in q.matchers):
                        take.append(n)
                        rule.append(i)
                        ms.add(outcomes)
                        es.add(extracts)
            kept = [b.column(c).take(pa.array(take, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rule, pa.int32()), ms.arrow(), es.arrow()], names=[*keep, "rule", "m", "e"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, f"{schema}, rule int, {_RAW}")


def scan(
    docs: DataFrame, rules: list[Rule], label: str = "label", content: str = "content", keep: list[str] | None = None, engine: str = "auto", guards: bool = True,
    compat_negative: bool = False, whole: bool = False, legacy: bool = False, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Findings of all rules over documents.

    ``docs`` has a label and a text content per row; ``keep`` names columns to
    carry along (the label by default). Null and empty contents have no
    findings; equal rows have equal findings; other columns are not read.
    ``guards`` only saves work: results are the same without. ``whole`` takes
    each content as one token at line 1 instead of its lines, ``legacy``
    applies a pattern matcher's condition within each token. Contents above
    ``max_bytes`` are left out; ``oversized`` gives them. Nothing is shuffled.

    Keys, expressions and named parts are evaluated by expressions only, so
    ``engine="arrow"`` refuses packs that ask for them, as it does the modes.
    """
    keep = keep or [label]
    asked = _requests(rules)
    rows = docs.where((F.col(content) != "") & (F.octet_length(content) <= max_bytes)).select(*keep, F.col(label).alias("__label"), F.col(content).alias("__content"))
    if not asked:
        raw = rows.where(F.lit(False)).select(*keep, F.lit(0).alias("rule"), F.array().cast(f"array<{match.RESULT}>").alias("m"), F.array().cast(f"array<{match.RESULT}>").alias("e"))
        return assemble(raw, [Rule("none", requests=[Request(extractors=[_never()])])], keep)
    operators = [x for _, q in asked for x in [*q.matchers, *q.extractors]]
    special = whole or legacy or any(x.type != "regex" for _, q in asked for x in q.extractors) or any(not match.of_content(x) for x in operators if x.type in ("word", "binary", "regex"))
    if special and engine == "arrow":
        raise ValueError("these rules or modes need the native engine")
    native = engine == "native" or engine == "auto" and (sum(len(x.regex) for x in operators) <= NATIVE_PATTERNS or special or _only_java(rules))
    raw = _native(rows, rules, keep, guards, whole, legacy) if native else _arrow(rows, rules, keep)
    return assemble(raw, rules, keep, compat_negative)


def oversized(docs: DataFrame, content: str = "content", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``scan`` leaves out for their size."""
    return docs.where(F.octet_length(content) > max_bytes)


def _never():
    from ..plans.rules import Extractor

    return Extractor(regex=[])


def scan_files(files: DataFrame, rules: list[Rule], filters: Filters = DEFAULTS, engine: str = "auto", root: str = "") -> DataFrame:
    """Findings over files (``path``, ``content`` binary): each rule over the files that its request takes.

    Media files and files in skipped folders are taken by none. A request that
    asks for MIME types takes and refuses files by their first bytes, however
    short they are. Rules of equal
    selection are scanned together; selection reads only the path, and the
    first bytes where a rule wants text.
    """
    from ..functions.text import is_mime, looks_like_text

    usable = files.where(~in_skipped_folder(F.col("path"), filters) & ~always_denied(F.col("path"), filters) & (F.octet_length("content") > 0))
    same: dict[tuple, list[Rule]] = {}
    for r in rules:
        for q in r.requests:
            one = Rule(r.id, r.name, r.severity, r.description, r.tags, [q])
            same.setdefault((tuple(sorted(q.extensions)), tuple(sorted(q.denylist)), q.archive, q.scan_all, q.max_size, q.mimetype), []).append(one)
    out = None
    # Entries are labelled archive:entry; other colons, as in a URI, mean nothing.
    mark = "(?:" + "|".join(re.escape(x) for x in [*filters.archive, ".tgz"]) + "):"
    entry = F.col("path").rlike(mark)
    for (ext, deny, archive, every, size, mime), group in sorted(same.items(), key=str):
        text = None if every else looks_like_text(F.col("content"))
        kinds, refused = ([x for x in xs if "/" in x] if mime else [] for xs in (ext, deny))
        ext = [x for x in ext if x not in kinds]
        inner = F.when(entry, F.regexp_extract("path", f"^.*{mark}(.*)$", 1)).otherwise(F.col("path"))
        by_path = selected(inner, ext, list(deny), archive, text, False, filters, root) if ext or not kinds else F.lit(False)
        by_kind = is_mime(F.col("content"), kinds)
        taken = usable.where(entry | by_kind | (by_path & ~is_mime(F.col("content"), refused)))
        if size:
            taken = taken.where(F.octet_length("content") <= size)
        docs = taken.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        found = scan(docs, group, "path", engine=engine)
        out = found if out is None else out.unionByName(found)
    return out
