import json

import pytest

from sievelake.operators import reports, scan
from sievelake.operators.windows import scan_blocks
from sievelake.plans.rules import Extractor, Matcher, Request, Rule, adhoc, choose, from_dict, grouped, load, problems, split_tags

TEXTS = [
    ("a", "first line\r\nToken = abc12345\r\n\r\nlast harbour"),
    ("b", "nothing here"),
    ("c", "harbour\nharbour treaty\n"),
    ("d", ""),
    ("e", None),
    ("f", "kéy: ünïcode Token = zz9zz9zz9\nTOKEN = yyyyyyyy1"),
    ("g", "x" * 50_000 + "\nToken = deepdeep1"),
    ("c", "harbour\nharbour treaty\n"),
]
TOKEN = r"(?i)token = (\w+)"


def rules():
    return [
        Rule("or", "Or", "high", requests=[Request(matchers=[Matcher(words=["treaty"]), Matcher(name="h", words=["harbour"])])]),
        Rule("and", "And", "low", requests=[Request(condition="and", matchers=[Matcher(words=["treaty"]), Matcher("regex", regex=["harb.ur"])])]),
        Rule("neg", "Neg", requests=[Request(matchers=[Matcher(words=["harbour"], negative=True)])]),
        Rule("ext", "Ext", requests=[Request(extractors=[Extractor(name="t", regex=[TOKEN], group=1), Extractor(regex=["line"], internal=True)])]),
        Rule("inner", requests=[Request(extractors=[Extractor(regex=["line"], internal=True)])]),
        Rule("bin", requests=[Request(matchers=[Matcher("binary", binary=["c3bc6e", "746f6b656e"], condition="and")])]),
        Rule("size", requests=[Request(matchers=[Matcher("size", size=[12])])]),
        Rule("bad", requests=[Request(matchers=[Matcher("regex", regex=["a*"])], extractors=[Extractor(regex=["t(o)"], group=5)])]),
    ]


def found(spark, **kw):
    df = spark.createDataFrame([(*t, "clash") for t in TEXTS], "label string, content string, rule string")
    return sorted(str(r.asDict(True)) for r in scan.scan(df, rules(), **kw).collect())


def test_semantics(spark):
    df = spark.createDataFrame(TEXTS, "label string, content string")
    f = scan.scan(df, rules()).collect()
    by = {(r.label, r.template_id): r for r in f}
    assert {k for k in by if k[1] == "or"} == {("a", "or"), ("c", "or")}
    assert list(by["c", "or"].matches) == ["matcher-0"] and list(by["a", "or"].matches) == ["h"]
    assert [h.line for h in by["a", "or"].matches["h"]] == [4] and by["a", "or"].matches["h"][0].byte_offset == 32
    assert {k[0] for k in by if k[1] == "and"} == {"c"} and {k[0] for k in by if k[1] == "neg"} == {"b", "f", "g"}
    assert by["f", "ext"].output_extracts == ["zz9zz9zz9", "yyyyyyyy1"] and by["f", "ext"].extracts[1].byte_offset == 34
    assert by["a", "ext"].named_extracts == {"t": ["abc12345"]} and [h.value for h in by["a", "ext"].extracts] == ["abc12345", "line"]
    assert not {k for k in by if k[1] in ("inner", "bad", "bin")}
    assert {k[0] for k in by if k[1] == "size"} == {"b"}
    assert sum(r.label == "c" and r.template_id == "or" for r in f) == 2  # repeated rows have repeated findings


def test_engines_and_guards_agree(spark):
    native = found(spark, engine="native")
    assert native == found(spark, engine="arrow") == found(spark, engine="native", guards=False)


def test_compatible_negation(spark):
    df = spark.createDataFrame([("a", "harbour"), ("b", "none")], "label string, content string")
    only = [r for r in rules() if r.id == "neg"]
    assert scan.scan(df, only).count() == 1 and scan.scan(df, only, compat_negative=True).count() == 2


def test_empty_tables_and_packs(spark):
    none = spark.createDataFrame([], "label string, content string")
    some = spark.createDataFrame(TEXTS, "label string, content string")
    assert scan.scan(none, rules()).count() == 0 and scan.scan(some, []).count() == 0 and scan.scan(none, rules(), engine="arrow").count() == 0


@pytest.mark.parametrize("at", [0, 900, 990, 995, 1000, 1900, 3000])
def test_window_equals_whole(spark, at):
    data = b"." * at + b"token=abcd1234" + b"\x00" * 2000 + b"token=abcd1234"
    df = spark.createDataFrame([("x", 5000, data), ("y", 0, None), ("z", 0, b"")], "label string, base long, content binary")
    f = scan_blocks(df, [adhoc(r"token=(\w{8})", group=1)], base="base", window=1000, overlap=50).collect()
    assert [h.byte_offset for h in f[0].extracts] == [5000 + at, 5000 + at + 2014] and len(f) == 1


def test_block_words_count_once(spark):
    data = b"." * 960 + b"secret" + b"." * 2000
    df = spark.createDataFrame([("x", data)], "label string, content binary")
    rule = Rule("w", requests=[Request(matchers=[Matcher(words=["SECRET"], case_insensitive=True)])])
    f = scan_blocks(df, [rule], window=1000, overlap=100).collect()
    assert [h.byte_offset for h in f[0].matches["matcher-0"]] == [960]


def test_rules(tmp_path):
    doc = {"id": "r", "info": {"name": "R", "severity": "high", "tags": "a, b"}, "file": [{"extensions": ["yaml"], "denylist": ["x"], "max-size": "5Mb", "matchers-condition": "and", "unknown": 1, "matchers": [{"type": "word", "words": ["w"], "case-insensitive": True}], "extractors": [{"type": "regex", "regex": ["(a)b"], "group": 1}]}]}
    r = from_dict(doc)
    assert r.tags == ["a", " b"] and r.requests[0].max_size == 5 << 20 and r.requests[0].matchers[0].case_insensitive and r.requests[0].condition == "and"
    assert from_dict({"id": "n"}) is None and from_dict({"id": "s", "sys": [1]}).sys == "[1]" and split_tags("") == []
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "r.json").write_text(json.dumps(doc))
    (tmp_path / "d" / "broken.json").write_text("{")
    assert [x.id for x in load(str(tmp_path))] == ["r"]
    with pytest.raises(ValueError):
        load(str(tmp_path / "d" / "broken.json"))
    assert choose([r], tags=["b"]) == [r] and choose([r], severities=["low"]) == [] and list(grouped([r])) == ["yaml"]
    assert len(problems(rules())) == 2


def test_reports(spark):
    df = spark.createDataFrame(TEXTS, "label string, content string")
    f = scan.scan(df, rules())
    hist = {r.severity: (r.severity_rank, r.n_findings) for r in reports.severity_histogram(f).collect()}
    assert hist["high"] == (2, 3) and hist["low"] == (4, 2) and hist[""][0] == 6
    assert reports.new_findings(f, f, ["label", "template_id"]).count() == 0
    j = json.loads(reports.as_json(f.where("label = 'a' and template_id = 'or'")).collect()[0].json)
    assert j["template-id"] == "or" and j["matches"] == {"h": [{"value": "harbour", "line": 4, "offset": 32}]}
    long = scan.scan(spark.createDataFrame([("l", "é" * 150)], "label string, content string"), [adhoc("é+")])
    assert reports.as_lines(long).collect()[0].text.endswith("é" * 100 + "...")


def test_mime_selection(spark):
    files = spark.createDataFrame([("a.bin", b"%PDF-1 token=1"), ("b.txt", b"token=2"), ("c.txt", b"PK\x03\x04 token=3"), ("d.png", b"%PDF token=4"), ("e.py", b"")], "path string, content binary")
    rule = lambda **kw: Rule("r", requests=[Request(mimetype=True, scan_all=True, extractors=[Extractor(regex=[r"token=(\d)"], group=1)], **kw)])
    got = lambda **kw: sorted(x for r in scan.scan_files(files, [rule(**kw)]).collect() for x in r.output_extracts)
    assert got(extensions=["application/pdf"]) == ["1"]
    assert got(extensions=["all"], denylist=["application/zip"]) == ["1", "2"]
    assert got(extensions=[".txt", "application/pdf"]) == ["1", "2", "3"]
