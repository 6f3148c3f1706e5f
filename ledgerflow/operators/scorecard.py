"""How well extraction does against golden rows, and on messages that state no transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.02


def scorecard(found: DataFrame, golden: DataFrame, keys: list[str], group: str = "institution", tolerance: float = TOLERANCE) -> DataFrame:
    """(group, n, amount_ok, type_ok, account_ok, all_ok): shares right, by group and over all (null group)."""
    want = golden.select(*keys, group, F.col("amount").alias("_amount"), F.col("type").alias("_type"), F.col("account_last4").alias("_account"))
    both = want.join(found.select(*keys, "amount", "type", "account_last4"), keys, "left")
    ok = both.select(group, (F.coalesce(F.abs(F.col("amount") - F.col("_amount")) <= tolerance, F.lit(False))).cast("int").alias("a"), F.coalesce(F.col("type") == F.col("_type"), F.lit(False)).cast("int").alias("t"), (F.col("_account").isNull() | F.coalesce(F.col("account_last4") == F.col("_account"), F.lit(False))).cast("int").alias("c"))
    return ok.rollup(group).agg(F.count("*").alias("n"), F.avg("a").alias("amount_ok"), F.avg("t").alias("type_ok"), F.avg("c").alias("account_ok"), F.avg(F.col("a") * F.col("t") * F.col("c")).alias("all_ok"))


def false_positives(found: DataFrame, negative: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n, false_positives): messages of a negative corpus from which a transaction was extracted."""
    hit = negative.select(*keys).join(found.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return hit.agg(F.count("*").alias("n"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("false_positives"))
