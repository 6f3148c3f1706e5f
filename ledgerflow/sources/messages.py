"""Message and transaction tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

def _newest() -> tuple:
    return F.col("ts").desc(), F.col("msg_id").asc()


def read_messages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A message store (user_id, _id, address, body, date in ms) as a message table."""
    raw = spark.read.schema(schema.STORE).format(form).load(path)
    return from_store(raw)


def from_store(raw: DataFrame) -> DataFrame:
    return raw.select("user_id", F.col("_id").alias("msg_id"), F.col("address").alias("sender"), "body", F.timestamp_millis("date").alias("ts"))


def newest_per_user(messages: DataFrame, n: int = 5000) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*_newest()))
    return messages.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def with_reject_reason(messages: DataFrame) -> DataFrame:
    """Adds why a row is no valid message: no_body, no_sender, bad_timestamp; else null."""
    reason = F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "no_body").when(F.coalesce(F.trim("sender"), F.lit("")) == "", "no_sender").when(F.col("ts").isNull() | (F.col("ts") < F.lit("1970-01-01").cast("timestamp")), "bad_timestamp")
    return messages.withColumn("reject_reason", reason)


def validate_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their reason: two views of one projection."""
    judged = with_reject_reason(messages)
    return judged.where("reject_reason IS NULL").drop("reject_reason"), judged.where("reject_reason IS NOT NULL")


def batches(messages: DataFrame, most: int = 100) -> DataFrame:
    """Numbers each user's rows into batches of 1 to ``most``, oldest first."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "msg_id")) - 1
    return messages.withColumn("batch", F.floor(place / most))


def insert_new(new: DataFrame, target: DataFrame | None, keys: tuple[str, ...] = ("user_id", "txn_id")) -> DataFrame:
    """The rows of ``new`` whose key is new, one a key: a second delivery adds nothing."""
    order = Window.partitionBy(*keys).orderBy("ts", "msg_id") if {"ts", "msg_id"} <= set(new.columns) else None
    one = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n") if order is not None else new.dropDuplicates(list(keys))
    return one if target is None else one.join(target.select(*keys), list(keys), "left_anti").select(*new.columns)


def write_transactions(tx: DataFrame, path: str, mode: str = "append") -> None:
    """By month, rows of a user together and in time order, so that month and user filters skip files and row groups."""
    rows = tx.withColumn("month", F.date_format("ts", "yyyy-MM"))
    rows.repartition("month", F.pmod(F.xxhash64("user_id"), F.lit(16))).sortWithinPartitions("month", "user_id", "ts").write.mode(mode).partitionBy("month").parquet(path)


def load_dictionary(rows: DataFrame, contract: T.StructType, keys: tuple[str, ...], patterns: tuple[str, ...] = ()) -> DataFrame:
    """Lookup rows in the contract's types; raises on a missing column, a wrong type, no row, a null, empty or double key, or a bad regex.

    One aggregate counts all faults. Regexes are tried on an empty text, so that a bad one fails here.
    """
    have = {f.name: f.dataType for f in rows.schema.fields}
    wrong = [f.name for f in contract.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"wrong or missing columns: {wrong}")
    rows = rows.select(*[f.name for f in contract.fields])
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    tried = [F.count(F.regexp_like(F.lit(""), F.col(p))).alias(f"tried_{p}") for p in patterns]
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(blank).alias("_blank"), *tried).agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).alias("double"), F.sum(F.col("_blank").cast("int")).alias("blank"), *[F.sum(f"tried_{p}") for p in patterns]).first()
    if not found["rows"]:
        raise ValueError("the dictionary is empty")
    if found["double"] or found["blank"]:
        raise ValueError(f"{found['double']} keys occur more than once, {found['blank']} are null or empty")
    return rows
