"""RE2 patterns for Spark: translation to Java's dialect, sound literals, globs."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest literal that is worth a test of its own.
MIN_LITERAL = 3

_SPACE, _BOUND = r"\t\n\f\r ", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# The POSIX classes and their Java names.
_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}",
    "space": r"\t\n\x0B\f\r ", "blank": r" \t", "xdigit": r"\p{XDigit}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}", "word": r"\w", "ascii": r"\p{ASCII}",
}


class Unsupported(ValueError):
    """A pattern that cannot be evaluated with RE2's meaning."""


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The Java form of the bracket expression at ``i`` and the position after it."""
    out, j = "[", i + 1
    if pattern[j : j + 1] == "^":
        out, j = out + "^", j + 1
    first = True
    while j < len(pattern):
        c = pattern[j]
        if c == "]" and not first:
            return out + "]", j + 1
        first = False
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, j):
            if m[2] not in _POSIX:
                raise Unsupported(f"unknown class {m[0]}")
            out += f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]]
            j = m.end()
        elif c == "\\":
            two = pattern[j : j + 2]
            out += {r"\s": _SPACE, r"\S": f"[^{_SPACE}]"}.get(two, two)
            j += 2
        else:
            out += "\\" + c if c in "[&^" and not (c == "^" and out == "[") or c == "]" else c
            j += 1
    raise Unsupported("bracket without end")


def to_java(pattern: str) -> str:
    """``pattern`` rewritten so that Java's engine gives RE2's matches.

    Raises Unsupported for what has no counterpart, and for patterns that match
    the empty string, whose repeated matches differ between engines.
    """
    flags, i, out, multiline = "d", 0, [], False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == r"\C" or len(two) < 2:
                raise Unsupported(f"{two} in {pattern!r}")
            if two == r"\Q":
                end = pattern.find(r"\E", i + 2)
                end = len(pattern) if end < 0 else end
                out.append(re.sub(r"([^0-9A-Za-z_])", r"\\\1", pattern[i + 2 : end]))
                i = end + 2
                continue
            out.append({r"\s": f"[{_SPACE}]", r"\S": f"[^{_SPACE}]", r"\b": _BOUND, r"\B": f"(?!{_BOUND})"}.get(two, two))
            i += 2
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
        elif c == "(" and (m := re.compile(r"\(\?([imsU]*)(-[imsU]+)?(:|\))").match(pattern, i)):
            if "U" in m[1] + (m[2] or ""):
                raise Unsupported("ungreedy flag")
            multiline |= "m" in m[1]
            on = m[1].replace("i", "iu")
            out.append(f"(?{on}{m[2] or ''}{m[3]}" if on or m[2] else "(?:" if m[3] == ":" else "")
            i = m.end()
        elif c == "(" and (m := re.compile(r"\(\?P?<(\w+)>").match(pattern, i)):
            out.append(f"(?<{re.sub('[^0-9A-Za-z]', '', m[1])}>")
            i = m.end()
        elif c == "$" and not multiline:
            out.append(r"\z")
            i += 1
        else:
            out.append(c)
            i += 1
    java = f"(?{flags})" + "".join(out)
    if _parsed(pattern) is not None and _parsed(pattern).getwidth()[0] == 0:
        raise Unsupported(f"{pattern!r} matches the empty string")
    return java


# The ASCII meaning of RE2's classes.
_ASCII = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}
_RANGES = {
    "alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\v\f\r ", "blank": r" \t",
    "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_", "cntrl": r"\x00-\x1f\x7f", "print": r"\x20-\x7e", "graph": r"\x21-\x7e", "ascii": r"\x00-\x7f",
    "punct": r"!-/:-@\[-`{-~",
}


def to_python(pattern: str) -> re.Pattern:
    """``pattern`` compiled by Python with RE2's meaning. Raises Unsupported as ``to_java`` does, and for what only Java can do."""
    to_java(pattern)
    out, i, inside, multiline = [], 0, False, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            kind = two[1:]
            if two == r"\Q" and not inside:
                end = pattern.find(r"\E", i + 2)
                end = len(pattern) if end < 0 else end
                out.append(re.escape(pattern[i + 2 : end]))
                i = end + 2
                continue
            if kind.lower() in _ASCII:
                if inside and kind.isupper():
                    raise Unsupported(f"{two} in brackets")
                out.append(_ASCII[kind] if inside else f"[{'^' if kind.isupper() else ''}{_ASCII[kind.lower()]}]")
            elif m := re.compile(r"\\x\{([0-9A-Fa-f]+)\}").match(pattern, i):
                out.append(re.escape(chr(int(m[1], 16))))
                i = m.end()
                continue
            else:
                out.append({r"\z": r"\Z", r"\b": two if inside else _BOUND, r"\B": f"(?!{_BOUND})"}.get(two, two))
            i += 2
        elif inside and (m := re.compile(r"\[:(\w+):\]").match(pattern, i)):
            out.append(_RANGES[m[1]])
            i = m.end()
        elif c == "[" and not inside:
            inside = True
            head = re.compile(r"\[\^?\]?").match(pattern, i)[0]
            out.append(head[:-1] + r"\]" if head.endswith("]") else head)
            i += len(head)
        elif c == "]" and inside:
            inside, i = False, i + 1
            out.append(c)
        elif not inside and (m := re.compile(r"\(\?([ims]*)(-[ims]+)?(:|\))").match(pattern, i)):
            multiline |= "m" in m[1]
            out.append(m[0])
            i = m.end()
        elif not inside and (m := re.compile(r"\(\?P?<(\w+)>").match(pattern, i)):
            out.append(f"(?P<{m[1]}>")
            i = m.end()
        else:
            out.append(r"\Z" if c == "$" and not inside and not multiline else "\\" + c if inside and c in "[&|~" else c)
            i += 1
    try:
        return re.compile("".join(out))
    except re.error as e:
        raise Unsupported(str(e)) from None


def _python(pattern: str) -> str:
    """A pattern of the same structure that Python can parse."""
    pattern = re.sub(r"\[:\^?(\w+):\]", "a-zA-Z", pattern)
    return re.sub(r"\\z", r"\\Z", pattern)


def _parsed(pattern: str):
    flags = 0
    if m := re.match(r"\(\?([ims]+)\)", pattern):
        pattern = pattern[m.end() :]
        flags = re.I if "i" in m[1] else 0
    try:
        return _parser.parse(_python(pattern), flags)
    except (re.error, OverflowError):
        return None


def groups(pattern: str) -> int:
    """Number of capture groups."""
    p = _parsed(pattern)
    return p.state.groups - 1 if p is not None else 0


def _required(items, lower: bool = True) -> list[str] | None:
    """Literals one of which every match of the sequence contains, or None."""
    best: list[str] | None = None
    run = ""

    def better(new: list[str] | None) -> None:
        nonlocal best
        if new and all(len(x) >= MIN_LITERAL for x in new):
            if best is None or (min(map(len, new)), -len(new)) > (min(map(len, best)), -len(best)):
                best = new

    for op, arg in items:
        if op is C.LITERAL and 32 <= arg < 127:
            run += chr(arg).lower() if lower else chr(arg)
            continue
        if op is C.AT:
            continue
        better([run])
        run = ""
        if op is C.SUBPATTERN:
            better(_required(arg[3], lower))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)) and arg[0] >= 1:
            better(_required(arg[2], lower))
        elif op is C.BRANCH:
            parts = [_required(b, lower) for b in arg[1]]
            if all(parts):
                better(sorted({x for p in parts for x in p}))
    better([run])
    return best


def literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match contains at least one, ignoring case; None if there are none.

    Sound: a text without any of them has no match. An alternative that has no
    literal of three characters makes the whole pattern one without literals.
    """
    p = _parsed(pattern)
    return None if p is None else _required(p)


def exact_literals(pattern: str) -> list[str] | None:
    """As ``literals``, in the pattern's own case; None where case may be ignored."""
    if re.search(r"\(\?[a-zA-Z]*i", pattern):
        return None
    p = _parsed(pattern)
    return None if p is None else _required(p, False)


def folded(text: Column) -> Column:
    """``text`` in lower case, also where only Unicode folding finds a plain letter."""
    rare = F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("\u212a"))
    return F.lower(F.when(rare, F.translate(text, "ſ\u212a", "sk")).otherwise(text))


def glob_to_regex(glob: str) -> str:
    """An anchored Java pattern for a path glob: ``*`` and ``?`` stay within a step, ``**`` doesn't."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end + 1
            continue
        if c == "{":
            depth, out = depth + 1, out + "(?:"
        elif c == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def split_glob(target: str) -> tuple[str, str]:
    """Base folder and pattern of a target: the base ends before the first step with a meta character."""
    at = min((target.find(c) for c in "*?[{" if c in target), default=-1)
    head = target if at < 0 else target[:at]
    cut = max(head.rfind("/"), head.rfind("\\"))
    return (target[:cut] or "/" if cut >= 0 else "."), target[cut + 1 :]
