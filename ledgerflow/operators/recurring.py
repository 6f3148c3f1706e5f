"""Recurring charges: one reading a day, the trailing run of monthly gaps, steady amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import merchant_key
from . import gates

LEAST_GAP, MOST_GAP, RECENT_DAYS = 20, 45, 60
DAY = 86_400_000_000


def latest_per_day(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys, F.to_date("ts")).orderBy(F.col("ts").desc(), "msg_id"))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def trailing_run(rows: DataFrame, keys: list[str], least: float = LEAST_GAP, most: float = MOST_GAP) -> DataFrame:
    """From the newest row back as long as each gap is of ``least`` to ``most`` days."""
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), "msg_id")
    later = F.lag("ts").over(newest)
    gap = (F.unix_micros(later) - F.unix_micros("ts")) / DAY
    rows = rows.withColumn("_bad", F.when(later.isNotNull() & ~gap.between(least, most), 1).otherwise(0))
    broken = F.sum("_bad").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_broken", broken).where("_broken = 0").drop("_bad", "_broken")


def recurring_charges(tx: DataFrame, as_of) -> DataFrame:
    """(user_id, merchant_key, currency, merchant, amount, count, last_date, confidence) as of a given time."""
    rows = gates.recurrence_candidates(tx).select("user_id", "msg_id", "ts", merchant_key(F.col("merchant")).alias("merchant_key"), F.coalesce("currency", F.lit("INR")).alias("currency"), "merchant", "amount").where("merchant_key <> ''")
    keys = ["user_id", "merchant_key", "currency"]
    run = trailing_run(latest_per_day(rows, keys), keys)
    order = F.struct("ts", "msg_id")
    out = run.groupBy(*keys).agg(F.count("*").alias("count"), F.max_by("amount", order).alias("amount"), F.max_by("merchant", order).alias("merchant"), F.max("ts").alias("last_date"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    steady = F.when(F.col("low") <= 0, F.col("low") == F.col("high")).otherwise((F.col("high") - F.col("low")) * 10 <= F.col("low"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_date")) / DAY
    out = out.where((F.col("count") >= 2) & steady & (age <= RECENT_DAYS))
    return out.select(*keys, "merchant", "amount", "count", "last_date", F.when(F.col("count") >= 3, "likely").otherwise("possible").alias("confidence"))


def monthly_recurring(charges: DataFrame) -> DataFrame:
    return charges.where("confidence = 'likely'").groupBy("user_id", "currency").agg(F.sum("amount").alias("monthly"))


def close_amounts(s: Column, a: Column) -> Column:
    return F.abs(s - a) * 10 <= F.greatest(s, a, F.lit(1).cast("decimal(18,2)"))


def flag_recurring(rows: DataFrame, charges: DataFrame, rolled: DataFrame) -> DataFrame:
    """Adds by_mandate, by_inference and recurring (either)."""
    known = rolled.select("user_id", "mandate_id", F.lit(True).alias("_m")).distinct()
    own = charges.select("user_id", F.col("merchant_key").alias("_key"), F.col("currency").alias("_currency"), F.col("amount").alias("_amount"))
    rows = rows.withColumns({"_key": merchant_key(F.col("merchant")), "_currency": F.coalesce("currency", F.lit("INR"))})
    rows = rows.join(known, ["user_id", "mandate_id"], "left").join(own, ["user_id", "_key", "_currency"], "left")
    inferred = F.coalesce(close_amounts(F.col("_amount"), F.col("amount")), F.lit(False))
    rows = rows.withColumns({"by_mandate": F.coalesce("_m", F.lit(False)), "by_inference": inferred})
    return rows.withColumn("recurring", F.col("by_mandate") | F.col("by_inference")).drop("_m", "_key", "_currency", "_amount")
