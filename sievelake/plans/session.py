"""Helpers that depend on how the session was configured.

Nothing here creates a session: operators take the caller's session and only
read from it, so the same code runs on ``local[*]`` and on a large cluster.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, named by ``spark.checkpoint.dir``.

    Only where the session names none (tests on a local master) a temporary
    folder is created and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sievelake-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; its lineage ends there.

    Used where a result is read several times or must not be recomputed
    differently after an executor is lost.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark reaches: whole under its name or not there, never overwritten."""
    fs, target = _hadoop(spark, path)
    part = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.part")[1]
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_below(spark: SparkSession, path: str) -> list[str]:
    """The sorted names of what lies directly in a folder; none if there is no such folder."""
    fs, p = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files or whole folders that are no longer read."""
    for path in paths:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with at least one partition per core, for CPU-heavy stages.

    A few small files would otherwise occupy a few cores only. Rows move by the
    hash of ``keys`` so that a recomputed partition holds the same rows. At
    scale the scan already has enough splits and ``df`` is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def ship(spark: SparkSession) -> None:
    """Makes this library importable by the session's Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sievelake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="sievelake-")) / "sievelake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))  # Spark distributes it from the driver
    sc._sievelake_shipped = True
