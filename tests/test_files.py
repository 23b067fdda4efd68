import io
import tarfile
import zipfile

from sievelake.operators import scan
from sievelake.plans.rules import adhoc
from sievelake.queries import TOKEN
from sievelake.sources import files as sources

TREE = {
    "app/.env": b"token = abcdefgh1234\n", "app/x.py": b"a = 1\npassword = 'zyxwvuts9'\n", "node_modules/y.js": b"secret: hidden1234\n", "pic.png": b"token = abcdefgh1234",
    ".git/config": b"token = gitgitgit1\n", "bin.dat": b"\x00token = abcdefgh1234", "a/b/c/d/e/_deep.txt": b"token = deepdeep12\n", "empty.txt": b"",
}


def planted(root):
    for name, data in TREE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("in/a.txt", "secret: insidezip1")
        z.writestr("in/pic.png", "x")
        z.writestr("in/none.txt", "")
    return root


def test_findings_of_a_tree(spark, tmp_path, monkeypatch):
    root = planted(tmp_path)
    want = {".git/config": "gitgitgit1", "app/.env": "abcdefgh1234", "app/x.py": "zyxwvuts9", "z.zip:in/a.txt": "insidezip1", "a/b/c/d/e/_deep.txt": "deepdeep12"}
    for folders, prefix in ((500, ""), (1, "file://")):  # one task lists all, or each hands its folders on
        monkeypatch.setattr(sources, "FOLDERS", folders)
        found = scan.scan_files(sources.corpus(spark, f"{prefix}{root}"), [adhoc(TOKEN, group=1)])
        got = {r.path.removeprefix(f"{prefix}{root}/"): r.output_extracts[0] for r in found.collect()}
        assert got == want
    assert [r.path.rsplit("/", 1)[1] for r in sources.list_files(spark, f"{root}/**/*.py").collect()] == ["x.py"]
    assert {r.path.removeprefix(f"{root}/") for r in sources.list_files(spark, str(root), recursive=False).collect()} == {"bin.dat", "empty.txt", "z.zip"}
    assert sources.list_files(spark, f"{root}/app/x.py").collect()[0].size == len(TREE["app/x.py"]) and sources.list_files(spark, f"{root}/no").count() == 0


def test_what_is_left_out(spark, tmp_path):
    root = planted(tmp_path)
    files = sources.list_files(spark, str(root))
    out = {r.path.rsplit("/", 1)[1]: r.reason for r in sources.left_out(files, 25).collect()}
    assert out == {"empty.txt": "empty", "x.py": "large", "z.zip": "large"}
    assert {len(r.content) for r in sources.read_files(files, 10, truncate=True).collect()} == {10}
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        for name, size in (("a", 5), ("b", 50), ("c.png", 5), ("d", 0), ("e", 5), ("f", 5)):
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(b"x" * size))
    packs = spark.createDataFrame([("p.tar.gz", data.getvalue()), ("q.tar.gz", data.getvalue()[:40]), ("r.txt", b"x")], "path string, content binary")
    r = {r.path: r for r in sources.archive_report(packs, max_entry=20, max_entries=2).collect()}
    assert set(r) == {"p.tar.gz", "q.tar.gz"} and r["q.tar.gz"].damaged == 1
    p = r["p.tar.gz"]
    assert (p.taken, p.empty, p.media, p.large, p.beyond, p.damaged) == (2, 1, 1, 1, 1, 0)
    assert sorted(x.path for x in sources.expand_archives(packs, max_entry=20, max_entries=2).collect()) == ["p.tar.gz:a", "p.tar.gz:e", "r.txt"]
