"""Streaming ingestion: message files in, transactions out, each once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import extract, routing
from ..sources import messages as M


def message_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema.MESSAGE).option("maxFilesPerTrigger", max_files).parquet(path)


#: Users of a batch that go into the filter on the target; batches of more look up all users of their months.
MOST_USERS = 1_000


def known_keys(tx: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of the transaction table among which a batch's keys can be: of its months, and of its users, if they are few.

    Partitions of other months are not listed; as files have their users in order, the filter on users lets the reader skip files, row groups
    and pages by their bounds, so a batch of few users reads little, however many users the months have.
    """
    months = [r[0] for r in tx.select(F.date_format("ts", "yyyy-MM")).distinct().collect()]
    users = [r[0] for r in tx.select("user_id").distinct().limit(MOST_USERS + 1).collect()]
    known = target.where(F.col("month").isin(months))
    return known if len(users) > MOST_USERS else known.where(F.col("user_id").isin([u for u in users if u is not None]))


def stream_transactions(source: DataFrame, rules: DataFrame, target: str, checkpoint: str, rejects: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Parses micro-batches and appends what is new to the transaction table at ``target``.

    The checkpoint replaces acknowledgement and retry. Every message is read, however late it comes: there is no watermark
    and no state, and a batch that runs again, or a message that comes again in a later batch, adds nothing, as the
    target's rows of the batch's months and users are joined with. Messages without a transaction go to ``rejects`` with their
    reason, in a folder for each stream and batch, which a batch that runs again writes anew.
    """
    from ..operators.gates import reject_reason

    spark = source.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            ok, bad = M.validate_messages(batch)
            tx = extract.extract_transactions(ok, rules).persist()
            jvm = spark.sparkContext._jvm
            there = jvm.org.apache.hadoop.fs.Path(target)
            fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            known = known_keys(tx, spark.read.parquet(target)) if fs.exists(there) else None
            M.write_transactions(M.insert_new(tx, known), target)
            if rejects:
                reason = F.coalesce("reject_reason", reject_reason(F.col("body")), F.lit("no_fields"))
                left = ok.join(tx.select("user_id", "msg_id"), ["user_id", "msg_id"], "left_anti").withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad)
                left.withColumn("reject_reason", reason).write.mode("overwrite").parquet(f"{rejects}/run={run}/batch={number}")
            tx.unpersist()
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def default_rules(spark: SparkSession) -> DataFrame:
    return routing.institutions(spark)
