"""Broadcasts of tables that are small enough, by their measured size; tasks by the size of the input; tables that are read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, written as JSON, up to which a dictionary is broadcast.
MOST_BYTES = 16 << 20
#: Bytes of input files whose rows one task sorts.
TASK_BYTES = 16 << 20


def few(df: DataFrame, most: int | None = None) -> bool:
    """Whether the rows of ``df``, written as JSON, have at most ``most`` bytes (``MOST_BYTES``). One aggregation, when the operator is called."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    return (df.agg(size).first()[0] or 0) <= (MOST_BYTES if most is None else most)


def small(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows have at most ``most`` bytes; else as it is, and Spark joins by shuffle.

    One aggregation measures it, when the operator is called.
    """
    return F.broadcast(df) if few(df, most) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled by ``key`` into tasks whose number follows the bytes of its input files, so that what a task sorts doesn't grow with them.

    Left to itself, Spark makes tasks by the bytes of the shuffle, which are few where places in texts compress well. Over
    little input, or what comes from no files, ``df`` is as it is.
    """
    context = df.sparkSession.sparkContext
    size, conf = 0, context._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(file))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df.repartition(max(-(-size // TASK_BYTES), context.defaultParallelism), key) if size > TASK_BYTES else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a new folder under ``spark.checkpoint.dir`` (where that is unset, as in tests, under a local one), read back: it is made once, however often it is read."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="ledgerflow-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
