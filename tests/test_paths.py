import pytest
from pyspark.sql import functions as F

from sievelake.functions import paths
from sievelake.functions.text import looks_like_text


def flags(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.ok for r in df.select("i", column(F.col("x")).alias("ok")).orderBy("i").collect()]


def test_parts(spark):
    assert flags(spark, ["a/.env", "a.tar.gz", "d.x/file", "C:\\u\\b.txt", None], paths.extension) == [".env", ".gz", "", ".txt", None]
    assert flags(spark, ["a/b/c.py", "c.py"], paths.folder) == ["a/b/", ""]


def test_selection(spark):
    names = ["config.yaml", "test.lock", "x.go", "m.csv", "n.png", "bin/tool", "vendor/a.js", "a/vendor/b.js", "k.zip"]
    every = lambda p: paths.selected(p, ["all", ".lock"], [".go", "vendor"])
    assert flags(spark, names, every) == [True, True, False, False, False, True, False, True, False]
    assert flags(spark, names, lambda p: paths.selected(p, ["yaml"], [])) == [True] + [False] * 8
    assert flags(spark, ["k.zip"], lambda p: paths.selected(p, ["all"], [], archive=True)) == [True]


def test_skipped_folders(spark):
    assert flags(spark, ["a/node_modules/b.js", ".git/config", "node_modules", "x/__pycache__/y"], paths.in_skipped_folder) == [True, False, False, True]


def test_text(spark):
    values = [b"", b"plain\ttext\r\n", b"a\x00b", b"\x01\x02\x03abc", "äöü".encode(), None]
    assert flags(spark, values, looks_like_text, "binary") == [True, True, False, False, True, None]


@pytest.mark.parametrize("text, n", [("5Mb", 5 << 20), ("1Gb", 1 << 30), ("12", 12), ("no", None), (None, None), ("1.5kb", 1536)])
def test_sizes(text, n):
    assert paths.human_size(text) == n
