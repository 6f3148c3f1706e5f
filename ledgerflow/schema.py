"""Schemas of messages, transactions, mandate and balance notices. Money is DECIMAL(18,2), times are TIMESTAMP (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

MESSAGE = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("msg_id", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

#: Rows of a phone's message store: renamed by ``sources.messages.read_messages``.
STORE = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("_id", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("date", T.LongType()),
])

TRANSACTION = T.StructType([
    *MESSAGE.fields,
    T.StructField("institution", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("type", T.StringType()),
    T.StructField("flow", T.StringType()),
    T.StructField("negated", T.BooleanType()),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("account_last4", T.StringType()),
    T.StructField("balance", MONEY),
    T.StructField("credit_limit", MONEY),
    T.StructField("is_card", T.BooleanType()),
    T.StructField("from_account", T.StringType()),
    T.StructField("to_account", T.StringType()),
    T.StructField("txn_id", T.StringType()),
])

#: Rule rows, by institution: how a sender is recognised and what its messages are.
INSTITUTION = T.StructType([
    T.StructField("prio", T.IntegerType()),
    T.StructField("institution", T.StringType()),
    T.StructField("sender_pattern", T.StringType()),
    T.StructField("type_override", T.StringType()),
    T.StructField("kind", T.StringType()),
])

# The names of types, and which way each counts.
TYPES = ("INCOME", "EXPENSE", "CREDIT", "TRANSFER", "INVESTMENT", "BALANCE_UPDATE")
RICH_TYPES = (*TYPES, "SALARY", "AUTO_DEBIT", "RECHARGE", "WALLET_CREDIT", "WALLET_DEBIT", "ATM_WITHDRAWAL")
#: Direction of each type in monthly totals; wallet top-ups and balance notices are neutral. CREDIT is spending by credit card.
OUT_TYPES = ("EXPENSE", "AUTO_DEBIT", "WALLET_DEBIT", "ATM_WITHDRAWAL", "TRANSFER", "RECHARGE", "INVESTMENT", "CREDIT")
IN_TYPES = ("INCOME", "SALARY")
