"""Files as a table: listing with all hidden files, reading on the executors, archives.

Spark's own file sources leave out names that begin with a dot or underscore,
which are of most interest here; so folders are listed and files are read by
the tasks, on any file system that Arrow knows: local and mounted folders,
``hdfs://``, ``s3://``, ``gs://``, ``abfs://``.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import DEFAULTS, Filters, extension, in_skipped_folder
from ..functions.regex import glob_to_regex, split_glob
from ..plans.session import checkpointed

#: Defaults: bytes of a file, bytes of an archive's entry and number of its entries that are taken.
MAX_FILE = 1 << 30
MAX_ENTRY, MAX_ENTRIES = 100 << 20, 10_000
#: Folders that a task lists before it hands the rest to other tasks.
FOLDERS = 500
_CHUNK = 32 << 20
_PROBLEMS = (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, RuntimeError, NotImplementedError, zlib.error)


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """The file system of a path or URI, the path on it, and what stands before that path in full names."""
    if "://" not in uri and not uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), os.path.abspath(uri), ""
    system, path = arrow_fs.FileSystem.from_uri(uri)
    plain = uri.split("?")[0].rstrip("/")
    return system, path, plain.removesuffix(path.rstrip("/"))


def _lister(recursive: bool, skipped: tuple[str, ...]):
    """Files, and the folders still to be listed, of a frame of folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting, listed = deque(b.column(0).to_pylist()), 0
            while waiting and listed < FOLDERS:
                listed += 1
                system, path, prefix = _open(waiting.popleft())
                local = isinstance(system, arrow_fs.LocalFileSystem)
                try:
                    found = sorted(system.get_file_info(arrow_fs.FileSelector(path, recursive=False)), key=lambda i: i.path)
                except OSError:
                    continue
                files = [i for i in found if i.type == arrow_fs.FileType.File and not (local and os.path.islink(i.path))]
                yield pa.RecordBatch.from_arrays([pa.array([prefix + i.path for i in files], pa.string()), pa.array([i.size for i in files], pa.int64()), pa.array([False] * len(files), pa.bool_())], names=["path", "size", "is_folder"])
                if recursive:
                    waiting += [prefix + i.path for i in found if i.type == arrow_fs.FileType.Directory and i.base_name not in skipped and not (local and os.path.islink(i.path))]
            yield pa.RecordBatch.from_arrays([pa.array(list(waiting), pa.string()), pa.array([None] * len(waiting), pa.int64()), pa.array([True] * len(waiting), pa.bool_())], names=["path", "size", "is_folder"])

    return run


def list_files(spark: SparkSession, target: str, recursive: bool = True, filters: Filters = DEFAULTS) -> DataFrame:
    """``(path, size)`` of the regular files of a file, folder or glob, each once.

    Folders named in ``filters.skipped_folders``, media files and links are
    left out, unreadable folders too. Each task lists up to FOLDERS folders
    from where it stands and hands the others on, so a deep or broad tree
    spreads over the cluster. Every executor must reach the file system.
    """
    pattern, base = None, target
    system, path, prefix = _open(target)
    if any(c in target for c in "*?[{") and system.get_file_info(path).type == arrow_fs.FileType.NotFound:
        base, rest = split_glob(target)
        pattern = glob_to_regex(rest)
        system, path, prefix = _open(base)
    info = system.get_file_info(path)
    root = prefix + path.rstrip("/") + "/"
    if info.type == arrow_fs.FileType.Directory:
        n = spark.sparkContext.defaultParallelism * 4
        level, out = spark.createDataFrame([(prefix + path,)], "folder string"), None
        while True:
            listed = checkpointed(level.repartition(n, "folder").mapInArrow(_lister(recursive, filters.skipped_folders), "path string, size long, is_folder boolean"))
            files = listed.where("not is_folder").select("path", "size")
            out = files if out is None else out.unionByName(files)
            level = listed.where("is_folder").select(F.col("path").alias("folder"))
            if level.isEmpty():
                break
        out = out.where(~in_skipped_folder(F.substr("path", F.lit(len(root) + 1)), filters))
    else:
        found = [(prefix + path, info.size)] if info.type == arrow_fs.FileType.File else []
        out = spark.createDataFrame(found, "path string, size long")
    out = out.where(~extension(F.col("path")).isin(list(filters.media)))
    return out.where(F.substr("path", F.lit(len(root) + 1)).rlike(pattern)) if pattern else out


def read_files(files: DataFrame, max_size: int = MAX_FILE, truncate: bool = False) -> DataFrame:
    """``(path, content)`` of listed files that aren't empty or above ``max_size``; with ``truncate`` longer ones are cut.

    Files that cannot be read are left out; ``left_out`` tells of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "content"]
        for b in batches:
            paths, contents, held = [], [], 0
            for p in b.column(0).to_pylist():
                try:
                    system, path, _ = _open(p)
                    with system.open_input_stream(path, compression=None) as f:
                        data = f.read(max_size)
                except OSError:
                    continue
                if data:
                    paths.append(p)
                    contents.append(data)
                    held += len(data)
                if held > _CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=names)
                    paths, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=names)

    usable = files.where("size > 0") if truncate else files.where((F.col("size") > 0) & (F.col("size") <= max_size))
    return usable.select("path").mapInArrow(run, "path string, content binary")


def left_out(files: DataFrame, max_size: int = MAX_FILE) -> DataFrame:
    """``(path, size, reason)`` of the listed files that ``read_files`` doesn't read: ``empty`` or ``large``."""
    reason = F.when(F.col("size") > max_size, "large").when(F.coalesce("size", F.lit(0)) <= 0, "empty")
    return files.select("path", "size", reason.alias("reason")).where("reason is not null")


def _tar(data: bytes, mode: str) -> Iterator[tuple[str, int, object]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as t:
        for m in t:
            if m.isreg():
                yield m.name, m.size, lambda m=m: t.extractfile(m).read()


def _zip(data: bytes) -> Iterator[tuple[str, int, object]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            if not i.is_dir():
                yield i.filename, i.file_size, lambda i=i: z.read(i)


def _members(path: str, data: bytes) -> Iterator[tuple[str, int, object]]:
    """(name, size, reader) of the entries of an archive, inflated one by one; nothing for other files."""
    ext = os.path.splitext(path)[1]
    if ext in (".gz", ".tgz"):
        yield from _tar(data, "r:gz")
    elif ext == ".tar":
        yield from _tar(data, "r:")
    elif ext in (".zip", ".jar", ".apk"):
        yield from _zip(data)


def entries(path: str, data: bytes, filters: Filters = DEFAULTS, max_entry: int = MAX_ENTRY, max_entries: int = MAX_ENTRIES, told: dict | None = None) -> Iterator[tuple[str, bytes]]:
    """``(archive:entry, content)`` of a tar, gzipped tar or zip archive.

    Empty and media entries, those above ``max_entry`` bytes and those after
    the first ``max_entries`` are left out; ``told`` counts them as taken,
    empty, media, large, beyond, and damaged archives, which give what comes
    before the damage. Other archives give none.
    """
    told = {} if told is None else told

    def count(what: str) -> None:
        told[what] = told.get(what, 0) + 1

    try:
        for name, size, read in _members(path, data):
            what = "media" if os.path.splitext(name)[1] in filters.media else "empty" if not size else "large" if size > max_entry else "beyond" if told.get("taken", 0) >= max_entries else "taken"
            if what != "taken":
                count(what)
                continue
            content = read()
            count(what)
            yield f"{path}:{name}", content
    except _PROBLEMS:
        count("damaged")


def _archives(filters: Filters):
    return extension(F.col("path")).isin([*filters.archive, ".tgz"])


def expand_archives(files: DataFrame, filters: Filters = DEFAULTS, max_entry: int = MAX_ENTRY, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``(path, content)``: archives replaced by their entries, labelled ``archive:entry``; other files as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, d in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                labels, contents, held = [], [], 0
                for label, content in entries(p, d or b"", filters, max_entry, max_entries):
                    labels.append(label)
                    contents.append(content)
                    held += len(content)
                    if held > _CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(contents, pa.binary())], names=["path", "content"])
                        labels, contents, held = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    opened = files.where(_archives(filters)).select("path", "content").mapInArrow(run, "path string, content binary")
    return files.where(~_archives(filters)).select("path", "content").unionByName(opened)


_TOLD = ("taken", "empty", "media", "large", "beyond", "damaged")


def archive_report(files: DataFrame, filters: Filters = DEFAULTS, max_entry: int = MAX_ENTRY, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Per archive how many entries are taken and how many are left out for which reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, d in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                told: dict = {}
                for _ in entries(p, d or b"", filters, max_entry, max_entries, told):
                    pass
                rows.append((p, *(told.get(k, 0) for k in _TOLD)))
            columns = list(zip(*rows)) if rows else [()] * (len(_TOLD) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["path", *_TOLD])

    return files.where(_archives(filters)).select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{k} long" for k in _TOLD))


def corpus(spark: SparkSession, target: str, recursive: bool = True, filters: Filters = DEFAULTS) -> DataFrame:
    """``(path, content)`` of everything below a target, archives opened."""
    return expand_archives(read_files(list_files(spark, target, recursive, filters)), filters)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes ``(path, content)`` rows as files below ``root``, by the tasks, when the returned ``(path, size)`` is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, prefix = _open(root)
        made: set[str] = set()
        for b in batches:
            paths, sizes = [], []
            for p, d in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                path = f"{base.rstrip('/')}/{p}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(path, compression=None) as f:
                    f.write(d or b"")
                paths.append(prefix + path)
                sizes.append(len(d or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size long")


def write_zip(files: DataFrame, path: str) -> None:
    """A zip of the given files' contents, streamed through the driver file by file, for handing over a few findings' files."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.select("path", "content").toLocalIterator():
            z.writestr(r.path.lstrip("/"), bytes(r.content))
