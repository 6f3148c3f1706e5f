"""Ledgers from enriched rows, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import direction_of, last4_or_empty

def _newest() -> tuple:
    return F.col("ts").desc(), F.col("msg_id").asc()


def monthly_totals(tx: DataFrame, kind: str = "rich_type", as_of=None) -> DataFrame:
    """(user_id, month, currency, income, expense, net) of all months, or of that of ``as_of``; currencies are never mixed."""
    rows = tx.where(F.col(kind).isNotNull() & F.col("amount").isNotNull()).withColumns({"month": F.trunc("ts", "MM"), "flow": direction_of(F.col(kind)), "currency": F.coalesce("currency", F.lit("INR"))})
    if "negated" in tx.columns:
        rows = rows.where("NOT negated")
    rows = rows.where("flow <> 'none'")
    if as_of is not None:
        rows = rows.where(F.col("month") == F.trunc(F.lit(as_of).cast("timestamp"), "MM"))
    total = lambda d: F.coalesce(F.sum(F.when(F.col("flow") == d, F.col("amount"))), F.lit(0).cast("decimal(18,2)"))
    return rows.groupBy("user_id", "month", "currency").agg(total("in").alias("income"), total("out").alias("expense")).withColumn("net", F.col("income") - F.col("expense"))


ACCOUNT = ("user_id", "bank_name", "last4")


def _account_rows(readings: DataFrame) -> DataFrame:
    return readings.where("bank_name IS NOT NULL AND balance IS NOT NULL").select("user_id", "bank_name", last4_or_empty(F.col("account_last4")).alias("last4"), "ts", "msg_id", "balance", F.coalesce("currency", F.lit("INR")).alias("currency"), "sender")


def account_history(readings: DataFrame) -> DataFrame:
    """A row a reading (account, ts, msg_id, balance, currency, sender), clustered by account and time: sorted ranges, so an account of any size is split over tasks."""
    order = [*ACCOUNT, F.col("ts").desc(), "msg_id"]
    return _account_rows(readings).repartitionByRange(*order).sortWithinPartitions(*order)


def account_balances(readings: DataFrame, newest: int | None = None) -> DataFrame:
    """(user_id, bank_name, last4, balance, currency, as_of, sender, readings, history newest first) by bank and last four digits.

    With ``newest``, a history has so many entries at most: tasks cut their own rows of an account to that many before they
    are shuffled, and headlines and counts are partial sums, so an account may have any number of readings. Without it, a
    history is all of one account; ``account_history`` has it as rows.
    """
    rows = _account_rows(readings)
    head = F.min_by(F.struct("balance", "currency", "ts", "sender"), F.struct(-F.unix_micros("ts"), "msg_id")).alias("head")
    heads = rows.groupBy(*ACCOUNT).agg(head, F.count("*").alias("readings"))
    entry = F.sort_array(F.collect_list(F.struct((-F.unix_micros("ts")).alias("age"), F.col("msg_id"), "ts", "balance", "currency", "sender"))).alias("history")
    if newest is None:
        out = rows.groupBy(*ACCOUNT).agg(head, F.count("*").alias("readings"), entry)
    else:
        few = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*ACCOUNT).orderBy(*_newest()))).where(F.col("_n") <= newest).groupBy(*ACCOUNT).agg(entry)
        both = [heads[c].eqNullSafe(few[c]) for c in ACCOUNT]
        out = heads.join(few, both[0] & both[1] & both[2]).select(*[heads[c] for c in ACCOUNT], "head", "readings", "history")
    history = F.transform("history", lambda x: F.struct(x["ts"].alias("ts"), x["balance"].alias("balance"), x["currency"].alias("currency"), x["sender"].alias("sender")))
    return out.select(*ACCOUNT, "head.balance", "head.currency", F.col("head.ts").alias("as_of"), "head.sender", "readings", history.alias("history"))


def earlier_readings(accounts: DataFrame) -> DataFrame:
    """Accounts with a history of what came before the headline's time."""
    return accounts.withColumn("history", F.filter("history", lambda x: x["ts"] != F.col("as_of")))


def mandates(events: DataFrame) -> DataFrame:
    """(user_id, mandate_id, merchant, amount, status, created_at, last_updated, history): first seen is newest, ties by msg_id."""
    order = F.struct(-F.unix_micros("ts"), "msg_id")
    entry = F.struct((-F.unix_micros("ts")).alias("age"), F.col("msg_id"), "ts", "status", "sender")
    known = F.col("amount").isNotNull()
    out = events.where("mandate_id IS NOT NULL").groupBy("user_id", "mandate_id").agg(
        F.min_by("merchant", order).alias("merchant"), F.min(F.when(known, F.struct(order.alias("o"), "amount")))["amount"].alias("amount"), F.min_by("status", order).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("last_updated"), F.sort_array(F.collect_list(entry)).alias("history")
    )
    return out.withColumn("history", F.transform("history", lambda x: F.struct(x["ts"].alias("ts"), x["status"].alias("status"), x["sender"].alias("sender"))))


def mandates_by_merchant(rolled: DataFrame) -> DataFrame:
    """(user_id, merchant, mandates newest first, last_updated)."""
    entry = F.struct((-F.unix_micros("last_updated")).alias("age"), "mandate_id", "amount", "status", "created_at", "last_updated")
    out = rolled.groupBy("user_id", "merchant").agg(F.sort_array(F.collect_list(entry)).alias("mandates"), F.max("last_updated").alias("last_updated"))
    return out.withColumn("mandates", F.transform("mandates", lambda x: F.struct(x["mandate_id"].alias("mandate_id"), x["amount"].alias("amount"), x["status"].alias("status"), x["created_at"].alias("created_at"), x["last_updated"].alias("last_updated"))))


def mandates_by_update(rolled: DataFrame) -> DataFrame:
    """Adds place: a user's mandates, the last updated first, ties by id."""
    return rolled.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last_updated").desc(), "mandate_id")))


def latest_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*_newest()))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def recent_feed(rows: DataFrame, n: int = 25) -> DataFrame:
    """Each user's newest ``n`` recognised rows, with their rank."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*_newest()))
    return rows.withColumn("feed_rank", rank).where(F.col("feed_rank") <= n)


def currencies(totals: DataFrame) -> DataFrame:
    """(user_id, currency, place): a user's currencies of income and expense, INR first; INR alone for a user with none."""
    found = totals.where("income > 0").select("user_id", "currency").union(totals.where("expense > 0").select("user_id", "currency")).distinct()
    users = totals.select("user_id").distinct()
    out = users.join(found, "user_id", "left").withColumn("currency", F.coalesce("currency", F.lit("INR")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("currency") != "INR", "currency")))
