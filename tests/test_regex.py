import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sievelake.functions import regex


@pytest.mark.parametrize(
    "pattern, literals",
    [
        (r"api_key\s*=", ["api_key"]),
        (r"(?i)TOKEN=\d+", ["token="]),
        (r"(alpha|beta)+x", ["alpha", "beta"]),
        (r"(alpha|be)x", None),
        (r"[a-z]+\d", None),
        (r"a{3}bcd", ["bcd"]),
        (r"(?:secret)?key=", ["key="]),
        (r"\bpass(?:word|wd)\b", ["passw"]),  # common beginnings of alternatives count
        (r"x\.y\.z", ["x.y.z"]),
    ],
)
def test_literals(pattern, literals):
    assert regex.literals(pattern) == literals


@given(st.lists(st.sampled_from(["foo", "ba", "quux", r"\d+", "[xy]", "(?:one|three)", "z?", "(?:left)*"]), min_size=1, max_size=5), st.text("fobaqux1yzonethrlf ", max_size=30))
def test_literals_are_sound(parts, text):
    pattern = "".join(parts)
    lits = regex.literals(pattern)
    if lits and re.search(pattern, text):
        assert any(x in text for x in lits)


def test_translation(spark):
    cases = [(r"a\sb", "a\x0bb", False), (r"a\sb", "a b", True), ("end$", "end\n", False), ("a.b", "a\rb", True), ("(?i)straße", "STRAßE", True), ("[[:alpha:]]+1", "ab1", True), ("[a&&b]x", "&x", True), ("(?P<n_1>ab)", "ab", True), (r"\Qa.b\E", "axb", False)]
    for pattern, text, found in cases:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.where(df.t.rlike(regex.to_java(pattern))).count() == found, pattern
    for bad in ("a*", "(?U)a+", r"\C"):
        with pytest.raises(regex.Unsupported):
            regex.to_java(bad)


@pytest.mark.parametrize("glob, path, hit", [("*.py", "a.py", True), ("*.py", "d/a.py", False), ("**/*.py", "d/e/a.py", True), ("**/*.py", "a.py", True), ("s?c/{a,b}.[ch]", "src/b.h", True), ("s?c/{a,b}.[ch]", "src/c.h", False), ("[!a].x", "a.x", False)])
def test_globs(glob, path, hit):
    assert bool(re.match(regex.glob_to_regex(glob), path)) == hit


def test_split_glob():
    assert regex.split_glob("/a/b/*.py") == ("/a/b", "*.py")
    assert regex.split_glob("/a/b/c") == ("/a/b", "c")
    assert regex.split_glob("*.py") == (".", "*.py")


@pytest.mark.parametrize(
    "pattern",
    [r"\w+\s\d+", r"(?i)kéy\s*=\s*(\w+)", r"[[:alpha:]_]+$", r"\bab\b", r"[^\s\d]{2,}", r"(?P<n_1>a+)(b)?", r"[]a]+", r"[&a|b]{2}", r"x.y", r"(?m)^a$", r"\Qa.b\E+", r"(?i:ÄB)c", r"[\w.]+@", r"\x{e9}t", "a|bc$"],
)
def test_python_and_java_agree(spark, pattern):
    texts = ["ab 12", "KÉY = vÄlue", "éab ab_ ab", "a\x0b1 a 1", "aab", "]a]", "&|a", "x\ry x\ny", "a\na\n", "a.bbb", "äbc ÄBc", "u.v@w é@", "été", "bc", "bc\n", ""]
    rx, java = regex.to_python(pattern), regex.to_java(pattern)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", f"regexp_extract_all(t, r'{java}', 0) as f").collect()
    assert {r.i: r.f for r in rows} == {i: [m[0] for m in rx.finditer(t)] for i, t in enumerate(texts)}
