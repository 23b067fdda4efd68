"""Credentials embedded in source code: finding and offset-preserving masking.

A text is searched in two steps. Context rules propose literal values: what is
assigned to a name that ends like a credential's, passed after a credential
option or in a URL's user part, follows an authorization scheme, or carries an
issuer's token format. A proposed value is then judged: placeholders,
references and hashes are discarded, and unless it has an issuer's format its
characters per subword under a public tokenizer vocabulary must be below a
limit, which is the lower the weaker the context and the plainer the value.

Rules begin at a credential's word and never scan the name before it, so the
time grows in proportion to the text, whatever its lines look like.

Masking replaces every character of a credential by ``*`` (line ends stay), so
the text keeps its length, its offsets and its syntax.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import spread, table
from .subwords import BYTE_BPE, chars_per_subword

#: Values with fewer characters per subword than this are unnatural; with more than the other, plain text even among digits.
UNNATURAL, WORDY = 2.7, 10.0

# All but the issuers' formats are matched on the text in lower case, so they need no case-blind search.
# Words that end the name of a credential.
_STRONG = (
    r"(?:pass(?:word|wd|phrase|wort|code)?|passwd|pwd|kennwort|mot_?de_?passe|secret|token|credentials?"
    r"|(?:api|signing|encryption|private|access|account|secret|auth|master|session|shared|service)[_.\- ]?key"
    r"|(?:redis|basic|http|proxy)[_.\- ]?auth)"
)
# The end of a name, and a whole name where its begin is known.
_END = rf"{_STRONG}(?:[_\-]?(?:value|v?\d{{1,3}}))?(?![a-z0-9_\-])"
_NAME = rf"[a-z0-9_.\-$:]*?{_END}"

# A quoted literal with its escapes, or a run up to a delimiter.
_QUOTED = r"""(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\r\n])*)(?P=q)"""

_ASSIGN = re.compile(
    rf"""{_END}\\?["'\]]{{0,2}}\s?(?::\s*(?:str|string)\s*)?[ \t]*(?P<sep>=>|:=|==?|:)[ \t]*"""
    rf"""(?:(?:\[\]byte\(|b|r|u|new\s+\w+\()?{_QUOTED}|(?P<block>[>|][+-]?[ \t]*\r?\n[ \t]*|\([ \t]*\r?\n[ \t]*|\r?\n[ \t]+)|(?P<b>[^\s"'`<>(){{}}\[\],;][^\s"'`<>,;]*))"""
)
_WEAK_ASSIGN = re.compile(rf"""(?:key|(?<![a-z0-9_])(?:signature|sig|sas|auth))["']?[ \t]*(?:=>|:=|=|:)[ \t]*(?:\[\]byte\()?(?:{_QUOTED}|(?P<b>[^\s"'`<>(){{}}\[\],;&]+))""")
_PAIR = re.compile(r"""auth(?<!\wauth)\s*=\s*\(\s*["'][^"'\r\n]*["']\s*,\s*(?P<q>["'])(?P<v>(?:\\.|(?!(?P=q))[^\\\r\n])*)(?P=q)""")
_HEADER = re.compile(r"""authorization["']?\s*[:=,]\s*["']?(?:bearer|basic|token|digest|apikey)\s+(?P<v>[^\s"'`,;]+)""")
_PROSE = re.compile(
    r"(?:pass(?:word|wd|phrase|wort|code)?|kennwort|mot\s+de\s+passe|secret|token|(?:api|access|signing|encryption)\s+key|pin(?:\s+code)?|code\s+pin|zugangscode|pin-code)"
    r"\s+(?:is|was|ist|war|lautet|est|are)(?:\s*:)?\s+[\"'`]?(?P<v>[^\s\"'`,;]+)"
)
_NAMED = re.compile(rf"[a-z0-9_.\-]*?{_STRONG}")
_PIECE = re.compile(r"""(?P<q>["'])(?P<v>(?:\\.|(?!(?P=q))[^\\\r\n])*)(?P=q)[ \t]*[+.\\]?[ \t]*(?:\r?\n[ \t]*)?""")
_LINE = re.compile(r"""(?P<v>[^\s"'<>]+)[ \t]*(?:\r?\n|\r|$)""")
_MARKER = re.compile(r"-----(?P<edge>BEGIN|END) (?P<what>(?:[A-Z0-9]+ )*[A-Z0-9]+)-----")
_WORD_BEFORE = re.compile(r"\w\Z")

_KEYWORDS = ("pass", "pwd", "kennwort", "secret", "token", "credential", "key", "auth")
#: Rules whose value is told by what stands around it: what the text must contain for one to apply, the rule, whether
#: the value is in quotes, and whether the context is weak.
_RULES = [
    (("<",), re.compile(rf"<{_NAME}(?:\s[^<>]*)?>(?P<v>[^<>]*)</"), False, False),
    (("</",), re.compile(rf"""=["']{_NAME}["']>(?P<v>[^<>]*)</"""), False, False),
    (("machine",), re.compile(r"machine(?<!\wmachine)\s+\S+\s+login\s+\S+\s+password\s+(?P<v>\S+)"), False, False),
    (("://",), re.compile(r"://(?<=[a-z0-9+.\-]://)[^\s:/@\"'<>]*:(?P<v>[^\s/@\"'<>]+)@"), False, False),
    ((" -u", "\t-u", "--user"), re.compile(r"""(?:\s-u|--user)[ =]["']?(?:(?!--user)[^\s:"'])+:(?P<v>[^\s"']+)"""), False, False),
    (("sshpass", "mysql", "redis-cli"), re.compile(r"""(?:sshpass\s+-p\s*|mysql(?:dump|admin)?\b[^\n|;&]{0,200}?\s-p|redis-cli\b[^\n|;&]{0,200}?\s-a\s+)(?P<q>["']?)(?P<v>[^\s"'|;&]+)(?P=q)"""), False, False),
    (("requirepass", "masterauth"), re.compile(r"(?:requirepass|masterauth)[ \t]+(?P<v>[^\s\"']+)"), False, False),
    (("env",), re.compile(rf"(?<!\S)env\s+{_NAME}\s+(?P<v>\S+)"), False, False),
    (("--",), re.compile(rf"""--(?<=\s--){_NAME}[ \t]+(?P<v>[^\s"'`=|;&-][^\s"'`=|;&]*)"""), False, True),
    (("=",), re.compile(rf"""=(?:(?<=key=)|(?<=name=)|(?<=id=))["']{_NAME}["']\s+value=(?P<q>["'])(?P<v>[^"'\r\n]*)(?P=q)"""), True, False),
    (("identified", "with"), re.compile(r"""(?:identified\s+by|with\s+password)\s+(?P<q>['"])(?P<v>(?:\\.|(?!(?P=q))[^\\\r\n])*)(?P=q)"""), True, False),
    (("auth",), _PAIR, True, False),
    (("(",), re.compile(rf"""\(\s*["'][a-z0-9_.\-]*(?:{_STRONG}|auth-key)["']\s*,\s*{_QUOTED}"""), True, False),
    (("?", "&"), re.compile(rf"[?&](?:[a-z0-9_\-]*{_STRONG}|sig|key|code|auth)=(?P<v>[^\s&\"'`<>#]+)"), False, True),
]

# Published token formats of issuers.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"A(?:KIA|SIA)[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"
    r"|gl(?:pat|dt|rt)-[A-Za-z0-9_\-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}"
    r"|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_\-]{16,}|dop_v1_[0-9a-f]{64}"
    r"|hv[sb]\.[A-Za-z0-9_\-]{20,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"
    r"|AIza[A-Za-z0-9_\-]{30,}"
    r"|(?<!-)eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r"|(?<=hooks\.slack\.com/services/)T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,}"
    r"|[a-z]{2,12}_(?:prod|production|stage|staging|test|live|dev|qa)_[0-9A-Za-z]{24,}"
    r")(?![A-Za-z0-9_])"
)

# What a text with an issuer's token contains.
_ISSUERS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "gldt-", "glrt-", "xox", "_live_", "_test_", "npm_", "pypi-", "dop_v1_", "hvs.", "hvb.", "SG.", "AIza", "eyJ", "hooks.slack.com", "_prod", "_stag", "_dev_", "_qa_")
_TRIGGERS = (*_KEYWORDS, "pin", "zugangscode", "mot_de_passe", "identified", "sig", "sas", "code=", "://", " -u", "\t-u", "\n-u", "--user", "mysql", "redis-cli", "hooks.slack", *{x.lower() for x in _ISSUERS})

_PLACEHOLDER = re.compile(
    r"""(?ix)^(?:
      change[_\-]?(?:me|it|this)?|todo|fixme|tbd|tba|n/?a|none|null|nil|undefined|unset|empty|true|false|yes|no|on|off
      |(?:example|sample|dummy|placeholder|redacted)(?:[_\-. ]?(?:[a-z]+|\d+)){0,4}|removed|hidden|masked
      |(?:your|my|the|insert|enter|replace|put|add|set|some)[_\- ].*|replaceme|insert.*here|.*[_\-\ ]here
      |(?:pass(?:word|wd|phrase|wort)?|pwd|secret|token|bearer|basic|api_?key|key|string|str|text|value|required|optional)
      |x{3,}.*|\*+|\.{2,}|-+|_+|\#+|0+|1234\w{0,6}
      |<.*|\[.*\]|%\w+%|%\(.*|\$[A-Za-z_{(].*|\{\{.*|\{.*\}|@\w+@|!{1,2}[a-z]+|ENC\[.*
    )$"""
)
_REFERENCE = re.compile(r"(?i)(?:process\.env|os\.(?:getenv|environ)|getenv|\bvault\b|secretsmanager|keyvault|\{\{|\$\{|\$\(|secrets?/|/secrets?|ssm:|arn:|ref\+|env\.|config\.|settings\.|self\.|\bthis\.|System\.)")
_HASH = re.compile(r"^(?:\$(?:2[abxy]?|1|5|6|argon2\w*|pbkdf2[\w\-]*|scrypt)\$.*|(?:sha(?:1|224|256|384|512)|md5)[:\-].*|\{(?:SSHA|SHA|MD5)\}.*|(?:ssh-|ecdsa-).*|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$", re.I)
_CODE = re.compile(r"^[A-Za-z_][\w.]*\(|^[A-Za-z_]\w*\[")
_DOTTED = re.compile(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")


def _literal(value: str, quoted: bool) -> bool:
    """Whether a value in the place of a credential is a literal one."""
    v = value.strip()
    if not v or _PLACEHOLDER.match(v) or _REFERENCE.search(v) or _HASH.match(v):
        return False
    if len(v) < 4 or len(set(v)) < 3:
        return False
    return quoted or not _CODE.match(v)


def _unnatural(value: str, path: str) -> bool:
    return len(value) >= 8 and chars_per_subword(value, path) < UNNATURAL


_WORDS = re.compile(r"[A-Za-zÀ-ɏ]+(?:[ _\-][A-Za-zÀ-ɏ]+)*")


def limit(value: str, quoted: bool, weak: bool) -> float:
    """The characters per subword that a value must stay below in its context.

    Behind a credential's name a mixed value may be made of words, and so may
    a phrase in quotes; labels and type names, which are ordinary words alone,
    may not, nor may anything in a weak context.
    """
    if weak:
        return UNNATURAL if len(value) >= 8 else 0.0
    if not _WORDS.fullmatch(value) or re.search(r"[a-z][A-Z]|[A-Z]{2}", value) or quoted and len(value) > 24:
        return WORDY
    return UNNATURAL if len(value) >= 8 else 0.0


def private_keys(text: str) -> tuple[list[tuple[int, int]], str]:
    """Spans of the private keys in ``text``, and the text with all marked blocks blanked, which hold no further values.

    A block without an end runs to the end of the text.
    """
    spans, blank, marks = [], [], list(_MARKER.finditer(text))
    ends: dict[str, list[int]] = {}
    private = []
    for m in marks:
        if m["edge"] == "END":
            ends.setdefault(m["what"], []).append(m.end())
            if "PRIVATE KEY" in m["what"]:
                private.append(m.end())
    done = after = 0
    for m in marks:
        if m["edge"] != "BEGIN":
            continue
        if m["what"].endswith(("PRIVATE KEY", "PRIVATE KEY BLOCK")) and m.start() >= after:
            k = bisect_right(private, m.end())
            if k < len(private):
                after = private[k]
                spans.append((m.start(), after))
        if m.start() >= done:
            mine = ends.get(m["what"], [])
            k = bisect_right(mine, m.end())
            done = mine[k] if k < len(mine) else len(text)
            blank.append((m.start(), done))
    out, at = [], 0
    for s, e in blank:
        out += [text[at:s], re.sub(r"[^\r\n]", "\x00", text[s:e])]
        at = e
    return spans, "".join([*out, text[at:]])


def _blocks(text: str, at: int, kind: str) -> list[tuple[int, int]]:
    """Literal values of an assignment that begins on the next line."""
    if kind[0] == "(":
        spans, m = [], _PIECE.match(text, at)
        while m:
            spans.append(m.span("v"))
            m = _PIECE.match(text, m.end())
        return spans
    m = _LINE.match(text, at)
    return [m.span("v")] if m and (kind[0] in ">|" or ":" not in m["v"]) else []


def _lowered(text: str) -> str:
    """``text`` in lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


def find_credentials(text: str | None, path: str = BYTE_BPE) -> list[tuple[int, int]]:
    """Spans of the credentials in ``text``, in order and without overlaps.

    Null and empty texts have none. The whole text is searched, in time
    proportional to it.
    """
    low = _lowered(text or "")
    if not any(x in low for x in _TRIGGERS):
        return []
    found: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        found, text = private_keys(text)
        low = _lowered(text)
    has = lambda *xs: any(x in low for x in xs)

    def add(span: tuple[int, int], quoted: bool, weak: bool = False) -> None:
        s, e = span
        v = text[s:e]
        if not quoted:  # closing brackets and points of the sentence around it
            n, surplus = len(v), v.count(")") - v.count("(")
            while n and v[n - 1] in ").:\\" and (surplus > 0 if v[n - 1] == ")" else surplus >= 0):
                surplus -= v[n - 1] == ")"
                n -= 1
            e, v = s + n, v[:n]
        if "\x00" in v or not _literal(v, quoted):
            return
        if not quoted and _DOTTED.match(v) and not _unnatural(v, path) or _NAMED.fullmatch(low, s, e):
            return
        if chars_per_subword(v, path) < limit(v, quoted, weak):
            found.append((s, e))

    if any(x in text for x in _ISSUERS):
        found += [m.span() for m in _ISSUED.finditer(text)]
    named = has(*_KEYWORDS, "mot_de_passe", "motdepasse")
    for m in _ASSIGN.finditer(low) if named else ():
        if m["block"]:
            for span in _blocks(text, m.end(), m["block"]):
                add(span, m["block"][0] == "(")
        elif m["q"]:
            add(m.span("v"), True)
        else:
            s, e = m.span("b")
            if text[e - 1 : e] == "(" or text[e : e + 1] == "(" or m["sep"] == ":" and text[e : e + 1] in ("(", "{"):
                continue
            amp = text.find("&", s, e)
            if amp > 0 and text.rfind("?", max(0, m.start() - 200), m.start()) >= 0:
                e = amp
            if text.startswith("/", s) or text[s - 1] == ":" and text[s : s + 2] == "//":
                continue
            add((s, e), False)
    for needed, rule, quoted, weak in _RULES:
        if has(*needed):
            for m in rule.finditer(low):
                add(m.span("v"), quoted, weak)
    for m in _HEADER.finditer(low) if has("authorization") else ():
        if not m["v"].startswith(("$", "{", "<", "%")):
            add(m.span("v"), False)
    for m in _PROSE.finditer(low) if named or has("pin", "zugangscode") else ():
        if not _WORD_BEFORE.search(low, max(0, m.start() - 1), m.start()):
            add(m.span("v"), False, weak=not re.search(r"\d", m["v"]))
    for m in _WEAK_ASSIGN.finditer(low) if has("key", "sig", "sas", "auth") else ():
        add(m.span("v") if m["q"] else m.span("b"), bool(m["q"]), weak=True)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and s < out[-1][1]:
            continue
        out.append((s, e))
    return out


_TOKEN = re.compile(r"[A-Za-z0-9_\-+/.!#%^*&$@~?]{10,60}={0,2}|[A-Za-z0-9]{6,24} [A-Za-z0-9]{4,24}")


def bare_credential(text: str | None, path: str = BYTE_BPE) -> bool:
    """Whether a value without any context is itself a credential.

    Only an unnatural string of letters of both cases counts, and one without
    digits only if it is further from words than any name is: digests,
    identifiers and encoded blocks of one case, of hexadecimal digits or with a
    digest's padding do not.
    """
    v = (text or "").strip()
    if not _TOKEN.fullmatch(v) or re.fullmatch(r"[0-9a-fA-F\-]+", v) or _HASH.match(v) or v.endswith("=="):
        return False
    if not (re.search("[a-z]", v) and re.search("[A-Z]", v)) or re.search(r"[/.@]|\$2", v):
        return False
    return chars_per_subword(v, path) < (2.4 if re.search("[0-9]", v) else 2.0)


def value_credentials(text: str | None, path: str = BYTE_BPE) -> list[tuple[int, int]]:
    """Spans of the credentials in a value that stands alone: by context, else the bare value itself."""
    spans = find_credentials(text, path)
    if text and not spans and bare_credential(text, path):
        s = len(text) - len(text.lstrip())
        return [(s, s + len(text.strip()))]
    return spans


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the characters of ``spans`` replaced by ``*``, line ends kept."""
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], re.sub(r"[^\r\n]", "*", text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``spans`` in order, those that overlap joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def occurrences(text: str | None, secrets: list[str]) -> list[tuple[int, int]]:
    """Places of known ``secrets`` in ``text``, found in one pass; also where the text is part of one."""
    if not text or not secrets:
        return []
    if len(text) >= 8 and any(text in x for x in secrets):
        return [(0, len(text))]
    automaton = ahocorasick.Automaton()
    for x in secrets:
        automaton.add_word(x, len(x))
    automaton.make_automaton()
    return _disjoint([(end + 1 - n, end + 1) for end, n in automaton.iter(text)])


def record_credentials(data: str | None, raw: str | None, path: str) -> list[str]:
    """Distinct credentials of a record with a matched value and the line it stands in.

    The line is the wider context; a matched value within it is judged there.
    """
    found = [raw[s:e] for s, e in value_credentials(raw, path)] if raw else []
    if data and (raw is None or data not in raw):
        found += [data[s:e] for s, e in value_credentials(data, path)]
    return list(dict.fromkeys(found))


def _texts(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return column.to_pylist()


def _finder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("secret", pa.string())])
        for b in batches:
            ids, out_id, out = b.column(0).to_pylist(), [], []
            raws = _texts(b.column(2)) if b.num_columns > 2 else [None] * len(ids)
            for i, data, raw in zip(ids, _texts(b.column(1)), raws):
                for x in record_credentials(data, raw, path):
                    out_id.append(i)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.string())], schema=schema)

    return run


def _extract_finder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("secret", pa.string())])
        for b in batches:
            out_id, out = [], []
            for i, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for v in values or ():
                    for s, e in value_credentials(v, path):
                        out_id.append(i)
                        out.append(v[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.string())], schema=schema)

    return run


def credentials(matches: DataFrame, findings: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``(src, row_id, secret)``: one row per record and distinct credential.

    ``matches`` needs match_id, match_data, raw_line; ``findings`` needs
    finding_id, extracts; other columns are not read. Records delivered twice
    count once, null fields hold nothing, empty tables give an empty result.
    Only the few credentials found are shuffled.
    """
    a = spread(matches.select("match_id", "match_data", "raw_line"), "match_id").mapInArrow(_finder(vocabulary), "row_id long, secret string")
    b = findings.select("finding_id", F.transform("extracts", lambda x: x["value_text"]).alias("v")).where("size(v) > 0")
    b = spread(b, "finding_id").mapInArrow(_extract_finder(vocabulary), "row_id long, secret string")
    named = lambda df, src: df.select(F.lit(src).alias("src"), "row_id", "secret")
    return named(a, "file_matches").unionByName(named(b, "findings")).distinct()


def redact_record(data: str | None, raw: str | None, path: str) -> tuple[str | None, str | None]:
    """A record's two fields with its credentials masked, wherever in them they stand."""
    known = record_credentials(data, raw, path)
    if not known:
        return data, raw
    again = [x for x in known if len(x) >= 8]  # a short one may be an ordinary word elsewhere
    masked = raw and mask(raw, _disjoint(value_credentials(raw, path) + occurrences(raw, again)))
    return data and mask(data, occurrences(data, known)), masked


def redact_matches(matches: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``matches`` with the credentials in match_data and raw_line masked.

    Every row and column comes out; only these two fields change, and they keep
    their length. Null stays null.
    """
    fields = [f.name for f in matches.schema.fields]
    at = {c: fields.index(c) for c in ("match_data", "raw_line")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [redact_record(d, r, vocabulary) for d, r in zip(b.column(at["match_data"]).to_pylist(), b.column(at["raw_line"]).to_pylist())]
            columns = list(b.columns)
            columns[at["match_data"]], columns[at["raw_line"]] = pa.array([d for d, _ in pairs], pa.string()), pa.array([r for _, r in pairs], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return matches.mapInArrow(run, matches.schema)


def redact_findings(findings: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``findings`` with the credentials in the values of extracts masked.

    Every row, column and extract comes out in its place; only the values
    change, and they keep their length. Null stays null.
    """
    fields = [f.name for f in findings.schema.fields]
    at = fields.index("extracts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at).to_pylist()
            for xs in lists:
                for x in xs or ():
                    if x and x["value_text"]:
                        x["value_text"] = mask(x["value_text"], value_credentials(x["value_text"], vocabulary))
            columns = list(b.columns)
            columns[at] = pa.array(lists, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return findings.mapInArrow(run, findings.schema)


def compare_redacted(values: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """What masking did to each kind of field, from the texts before and after it.

    ``values`` has src, field_name, before and after. Columns: src, field_name,
    n_values, n_masked (values that changed), n_masked_chars, n_moved (values
    whose length or line ends changed), n_code_chars_changed (characters that
    became anything but the mask) and n_left (values in which a credential is
    still found). Null values are left out.
    """
    schema = pa.schema([("src", pa.string()), ("field_name", pa.string())] + [(c, pa.int64()) for c in ("n_masked", "n_masked_chars", "n_moved", "n_code_chars_changed", "n_left")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                left = int(bool(value_credentials(y, vocabulary)))
                if x == y:
                    out.append((0, 0, 0, 0, left))
                    continue
                p, q = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
                if len(p) != len(q):
                    out.append((1, 0, 1, 0, left))
                    continue
                changed, ends = p != q, (p == 10) | (p == 13)
                out.append((1, int((changed & (q == ord("*"))).sum()), int((changed & ends).any()), int((changed & (q != ord("*"))).sum()), left))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5))], schema=schema)

    ddl = "src string, field_name string, " + ", ".join(f"{f.name} long" for f in schema if f.type == pa.int64())
    told = values.where("before is not null").select("src", "field_name", "before", "after").mapInArrow(run, ddl)
    return told.groupBy("src", "field_name").agg(F.count("*").alias("n_values"), *[F.sum(f.name).alias(f.name) for f in schema if f.type == pa.int64()])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(table(spark, sf_dir, "file_matches"), table(spark, sf_dir, "findings"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables before and after masking, compared field by field."""
    m = spread(table(spark, sf_dir, "file_matches").withColumns({"data_before": F.col("match_data"), "line_before": F.col("raw_line")}), "match_id")
    f = spread(table(spark, sf_dir, "findings").select("finding_id", "extracts", F.col("extracts").alias("before")), "finding_id")
    pair = lambda field, before, after: F.struct(F.lit("file_matches").alias("src"), F.lit(field).alias("field_name"), F.col(before).alias("before"), F.col(after).alias("after"))
    of_matches = redact_matches(m).select(F.inline(F.array(pair("match_data", "data_before", "match_data"), pair("raw_line", "line_before", "raw_line"))))
    both = F.zip_with("before", "extracts", lambda x, y: F.struct(x["value_text"].alias("before"), y["value_text"].alias("after")))
    of_findings = redact_findings(f).select(F.inline(both)).select(F.lit("findings").alias("src"), F.lit("extracts").alias("field_name"), "before", "after")
    return compare_redacted(of_matches.unionByName(of_findings))
