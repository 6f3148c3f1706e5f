"""Helpers that every operator of this subpackage shares: the shared folder, written tables, text columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(df: DataFrame) -> SparkSession:
    """The frame's session, told where Python workers find this package when they run from another folder."""
    spark = df.sparkSession
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if REPO not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{REPO}:{paths}" if paths else REPO
    return spark


_local: list[str] = []
_scopes: list[list[tuple[str, str]]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; only where that is unset (tests), under a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="ledgerflow-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = session(df)
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    if _scopes:
        _scopes[-1].append((name, path))
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the folder of a written table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Tables written within it are deleted at its end, but for those of the names ``keep``, which the result still reads."""
    _scopes.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for name, path in _scopes.pop():
            if name not in keep:
                folder = context._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Jobs within it drop their shuffle files when they end: for steps whose result is a written table, so that files of one don't lie beside those of the next."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``keys``.

    A filter by a bound on the hash, from the number of rows, goes first: so the sort sees little more than ``n`` rows,
    wherever they are, and none but those leave their task.
    """
    total = df.count()
    hashed = F.xxhash64(*keys)
    if total > n:
        df = df.where(hashed <= int(-(2**63) + min(1.0, (1.2 * n + 100) / total) * (2**64 - 1025)))
    return df.orderBy(hashed, *keys).limit(n)
