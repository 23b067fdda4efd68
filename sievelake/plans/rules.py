"""Rules: their form, their sources, and their compilation at plan time."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions import regex
from ..functions.paths import human_size

try:
    import yaml
except ImportError:
    yaml = None

#: A term of the small expression language: a comparison of a part or its length, or a test of what a part contains.
DSL = re.compile(r"^\s*(?:len\((\w+)\)|(\w+))\s*(==|!=|>=|<=|>|<)\s*(\d+|\"[^\"]*\"|'[^']*')\s*$|^\s*(contains|starts_with|ends_with)\((\w+),\s*[\"']([^\"']*)[\"']\)\s*$")
SEVERITIES = ("critical", "high", "medium", "low", "info")


@dataclass
class Matcher:
    type: str = "word"
    name: str | None = None
    part: str | None = None
    condition: str = "or"
    words: list[str] = field(default_factory=list)
    regex: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    dsl: list[str] = field(default_factory=list)
    negative: bool = False
    case_insensitive: bool = False
    match_all: bool = False


@dataclass
class Extractor:
    type: str = "regex"
    name: str | None = None
    part: str | None = None
    regex: list[str] = field(default_factory=list)
    group: int = 0
    kval: list[str] = field(default_factory=list)
    dsl: list[str] = field(default_factory=list)
    internal: bool = False


@dataclass
class Request:
    extensions: list[str] = field(default_factory=lambda: ["all"])
    denylist: list[str] = field(default_factory=list)
    max_size: int | None = None
    archive: bool = False
    mimetype: bool = False
    scan_all: bool = False
    no_recursive: bool = False
    condition: str = "or"
    matchers: list[Matcher] = field(default_factory=list)
    extractors: list[Extractor] = field(default_factory=list)


@dataclass
class Rule:
    id: str
    name: str = ""
    severity: str = ""
    description: str = ""
    tags: list[str] = field(default_factory=list)
    requests: list[Request] = field(default_factory=list)
    sys: str | None = None
    category: str = ""

    @property
    def literals(self) -> list[str] | None:
        return rule_literals(self)


def split_tags(text: str | None) -> list[str]:
    """The comma-separated tags, blanks kept; nothing for an empty text."""
    return text.split(",") if text else []


def _pick(cls, d: dict, names: dict[str, str]) -> dict:
    known = cls.__dataclass_fields__
    out = {}
    for k, v in d.items():
        k = names.get(k, k.replace("-", "_"))
        if k in known and v is not None:
            out[k] = v
    return out


def from_dict(d: dict) -> Rule | None:
    """A rule from a parsed document; unknown keys are ignored. None if it has neither ``file`` nor ``sys`` requests."""
    requests = d.get("file") or []
    if not requests and not d.get("sys"):
        return None
    info = d.get("info") or {}
    out = Rule(str(d.get("id") or ""), info.get("name") or "", info.get("severity") or "", info.get("description") or "", split_tags(info.get("tags")))
    out.sys = json.dumps(d["sys"]) if d.get("sys") else None
    for r in requests:
        q = Request(**_pick(Request, {k: v for k, v in r.items() if k not in ("matchers", "extractors", "max-size")}, {"matchers-condition": "condition"}))
        q.max_size = human_size(r.get("max-size"))
        q.matchers = [Matcher(**_pick(Matcher, m, {})) for m in r.get("matchers") or []]
        q.extractors = [Extractor(**_pick(Extractor, e, {})) for e in r.get("extractors") or []]
        out.requests.append(q)
    return out


def load(path: str) -> list[Rule]:
    """Rules of a YAML or JSON file, or of all such files below a folder.

    In a folder unreadable files are skipped; a single one raises.
    """
    p = Path(path)
    files = sorted(x for x in p.rglob("*") if x.suffix in (".yaml", ".yml", ".json")) if p.is_dir() else [p]
    out = []
    for f in files:
        try:
            text = f.read_text()
            doc = json.loads(text) if f.suffix == ".json" else _yaml(text)
            rule = from_dict(doc)
        except Exception:
            if p.is_dir():
                continue
            raise
        if rule:
            rule.category = f.relative_to(p).parts[0] if p.is_dir() and f.parent != p else ""
            out.append(rule)
    return out


def ignored(text: str) -> list[str]:
    """The rule ids of an ignore file: one a line, without blank lines and comments (``#``)."""
    lines = (x.split("#")[0].strip() for x in text.splitlines())
    return [x for x in lines if x]


def _yaml(text: str) -> dict:
    if yaml is None:
        raise RuntimeError("reading YAML rules needs PyYAML; JSON rules don't")
    return yaml.safe_load(text)


def from_table(rules: DataFrame) -> list[Rule]:
    """Rules of a table of the rules' schema, ordered by id. Nulls take the defaults. A rule pack is configuration: it is read to the driver."""
    out = []
    for r in sorted(rules.collect(), key=lambda r: r.rule_id or ""):
        requests = []
        for q in r.requests or []:
            ms = [
                Matcher(m.matcher_type, m.matcher_name, m.part_name, m.words_condition or "or", list(m.words or []), list(m.regexes or []), list(m.hex_patterns or []), list(m.sizes or []), list(m.dsl or []), bool(m.negative), bool(m.case_insensitive), bool(m.match_all))
                for m in q.matchers or []
            ]
            es = [Extractor(e.extractor_type, e.extractor_name, e.part_name, list(e.regexes or []), e.capture_group or 0, list(e.kval or []), list(e.dsl or []), bool(e.is_internal)) for e in q.extractors or []]
            requests.append(Request(list(q.extensions or ["all"]), list(q.denylist or []), q.max_size, bool(q.scan_archive), bool(q.mimetype), bool(q.scan_all), bool(q.no_recursive), q.matchers_condition or "or", ms, es))
        out.append(Rule(r.rule_id, r.rule_name or "", r.severity or "", r.description or "", list(r.tags or []), requests))
    return out


def adhoc(*patterns: str, rule_id: str = "adhoc", group: int = 0) -> Rule:
    """A rule of one extractor with the given patterns."""
    return Rule(rule_id, rule_id, "info", requests=[Request(extractors=[Extractor(regex=list(patterns), group=group)])])


def choose(rules: list[Rule], ids: list[str] | None = None, tags: list[str] | None = None, severities: list[str] | None = None, extensions: list[str] | None = None, exclude_tags: list[str] | None = None, exclude_ids: list[str] | None = None, categories: list[str] | None = None) -> list[Rule]:
    """The rules that have one of the given values in each property asked for, and none of the excluded ones.

    A rule's category is the folder below the rules' folder that it was loaded from.
    """

    def ok(r: Rule) -> bool:
        takes = {e for q in r.requests for e in q.extensions}
        return (
            (not ids or r.id in ids)
            and (not tags or bool({*tags} & {t.strip() for t in r.tags}))
            and (not severities or r.severity in severities)
            and (not extensions or "all" in takes or bool({*extensions} & takes))
            and not (exclude_ids and r.id in exclude_ids)
            and (not categories or r.category in categories)
            and not (exclude_tags and {*exclude_tags} & {t.strip() for t in r.tags})
        )

    return [r for r in rules if ok(r)]


def grouped(rules: list[Rule]) -> dict[str, list[tuple[Rule, Request]]]:
    """Requests by the extensions they take, in a fixed order."""
    out: dict[str, list] = {}
    for r in rules:
        for q in r.requests:
            key = "all" if "all" in q.extensions or not q.extensions else ",".join(sorted(q.extensions))
            out.setdefault(key, []).append((r, q))
    return dict(sorted(out.items()))


def problems(rules: list[Rule]) -> list[tuple[str, str]]:
    """``(rule id, what)`` of everything that cannot be evaluated.

    The scan leaves such patterns out, takes such expressions for false and
    looks for words with ``{{`` as they stand, for there are no variables.
    """
    out = []
    for r in rules:
        for q in r.requests:
            for p in [p for m in q.matchers for p in m.regex] + [p for e in q.extractors for p in e.regex]:
                try:
                    regex.to_java(p)
                    if regex._parsed(p) is None:
                        raise regex.Unsupported(f"cannot parse {p!r}")
                except regex.Unsupported as e:
                    out.append((r.id, str(e)))
            for x in [x for op in [*q.matchers, *q.extractors] for x in op.dsl]:
                if not all(DSL.match(t) for side in x.split(" || ") for t in side.split(" && ")):
                    out.append((r.id, f"expression {x!r}"))
            out += [(r.id, f"variables in word {w!r}") for m in q.matchers for w in m.words if "{{" in w]
            for e in q.extractors:
                out += [(r.id, f"group {e.group} of {p!r}") for p in e.regex if e.group > regex.groups(p)]
    return out


def request_literals(q: Request) -> list[str] | None:
    """Literals one of which a content must contain for the request to find anything; None if it may find something in any.

    Words, patterns and nothing else have literals: negative matchers, sizes,
    expressions and bytes may hold for any content.
    """
    out: set[str] = set()
    # Under 'and' a matcher that must hold suffices; what it needs, the request needs.
    needed = []
    for m in q.matchers:
        lits: list[str] | None = None
        if (m.part or "") not in ("", "body", "all", "data", "raw"):
            pass  # looks elsewhere
        elif not m.negative and m.type == "word" and m.words and all(len(w) >= regex.MIN_LITERAL and w.isascii() for w in m.words):
            lits = [w.lower() for w in m.words]
        elif not m.negative and m.type == "regex" and m.regex:
            per = [regex.literals(p) for p in m.regex]
            lits = sorted({x for p in per for x in p}) if all(per) else None
        needed.append(lits)
    if q.matchers:
        if q.condition == "and":
            return min((n for n in needed if n), key=len, default=None)
        if not all(needed):
            return None
        return sorted({x for n in needed for x in n})
    for e in q.extractors:
        per = [regex.literals(p) for p in e.regex] if e.type == "regex" and e.regex and (e.part or "") in ("", "body", "all", "data", "raw") else [None]
        if not all(per):
            return None
        out |= {x for p in per for x in p}
    return sorted(out) or None


def rule_literals(rule: Rule) -> list[str] | None:
    per = [request_literals(q) for q in rule.requests]
    return sorted({x for p in per for x in p}) if per and all(per) else None
