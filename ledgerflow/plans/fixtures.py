"""Message tables that Spark derives from ``orders``: the truth of every field stays in the source columns.

``MACROS`` holds the parts of the texts as SQL that Spark and the oracles' engine share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

K, C = "o_orderkey", "o_custkey"
MACROS = {
    "AMT": "cast(cast(o_totalprice as decimal(18,2)) as {S})",
    "BAL": "cast(cast(o_totalprice*2 as decimal(18,2)) as {S})",
    "TAIL": "lpad(cast(o_custkey % 10000 as {S}),4,'0')",
    "OTHER": "lpad(cast((o_custkey * 7 + 1111) % 10000 as {S}),4,'0')",
    "DAY": "cast(cast(o_orderdate as date) as {S})",
    "REF": "lpad(cast(o_orderkey as {S}),12,'0')",
    "PHONE": "concat('98', lpad(cast(o_orderkey % 100000000 as {S}),8,'0'))",
    "SIX": "lpad(cast(o_orderkey % 1000000 as {S}),6,'0')",
    "SHOP": "concat('SHOP', cast(o_custkey % 37 as {S}))",
    "PAYER": "concat('PAYER', cast(o_custkey % 11 as {S}))",
    "STORE": "concat('STORE', cast(o_custkey % 23 as {S}))",
    "SERVICE": "concat('SERVICE', cast(o_custkey % 7 as {S}))",
    "CITY": "concat('CITY', cast(o_custkey % 9 as {S}))",
}
AMOUNT, BALANCE = "cast(cast(o_totalprice as decimal(18,2)) as double)", "cast(cast(o_totalprice*2 as decimal(18,2)) as double)"


def expand(template: str, string: str) -> str:
    """A text template with {NAME} parts as an SQL expression."""
    import re

    parts = []
    for i, x in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(MACROS[x].replace("{S}", string) if i % 2 else "'" + x.replace("'", "''") + "'")
    return "concat(" + ", ".join(p for p in parts if p != "''") + ")"


def sql(expr: str) -> str:
    """``expr`` with {NAME} parts, for the oracles' engine."""
    for k, v in MACROS.items():
        expr = expr.replace("{" + k + "}", v.replace("{S}", "varchar"))
    return expr


SHAPES = (
    "Rs.{AMT} debited from A/c XX{TAIL} to {SHOP} on {DAY}. Avl Bal Rs.{BAL} Ref {REF}",
    "INR {AMT} credited to A/c XX{TAIL} from {PAYER} on {DAY}. Available Balance: INR {BAL}",
    "USD {AMT} spent on Card XX{TAIL} at {STORE} on {DAY}",
    "Your OTP is {SIX}. Valid for 10 minutes.",
    "Available Balance in A/c XX{TAIL} is Rs.{BAL} as on {DAY}",
)
#: More shapes, for the fields of other families: a message has that of its order key modulo their number.
RICH = (
    "Rs.{AMT} debited from A/c XX{TAIL} to {SHOP} on {DAY}. Avl Bal Rs.{BAL} Ref {REF}",  # 0
    "INR {AMT} salary credited to A/c XX{TAIL} on {DAY}",
    "Your data plan is valid till {DAY}. 1.5 GB data left",
    "Rs.{AMT} added to your wallet from A/c XX{TAIL}",
    "Rs.{AMT} paid from your wallet to {SHOP}",
    "Recharge of Rs.{AMT} successful for {PHONE}",  # 5
    "Rs.{AMT} debited from A/c XX{TAIL} by auto-debit for {SERVICE}",
    "Rs.{AMT} withdrawn from A/c XX{TAIL} at ATM {CITY} on {DAY}",
    "Rs.{AMT} transferred via NEFT to {PAYER} from A/c XX{TAIL}. UTR UT{REF}",
    "Rs.{AMT} debited from A/c XX{TAIL} for SIP in folio no F{SIX}",
    "Your OTP is {SIX}. Valid for 10 minutes.",  # 10
    "PNR P{SIX} Flight AI-202 Delhi-Mumbai departs 10:30 arrives 12:45 fare Rs.{AMT} gate B12 then Train no T{SIX}",
    "Your order no OD{REF} is shipped. AWB AW{REF} for item I{SIX}",
    "Bill of Rs.{AMT} for policy no PL{SIX} is due on {DAY}. EMI of Rs.{BAL}",
    "Use code SAVE20 and get 20% off, cashback of Rs.{AMT} offer",
    "Pack balance Rs.{AMT} and 250 MB left on your pack",  # 15
    "NAV of Rs.{AMT} for folio no F{SIX} margin Rs.{BAL}",
    "A/c XX{TAIL} debited Rs.{AMT} UPI/P2A/{REF}/{PAYER}",
    "A/c XX{TAIL} debited for Rs.{AMT} and A/c XX{OTHER} credited",
    "Upcoming mandate: Rs.{AMT} will be debited on {DAY} towards {SERVICE}. Mandate no MN{SIX}",
    "Your A/c XX{TAIL} Available Balance is Rs.{BAL} DR",  # 20
    "Rs.{AMT} paid to grngrcr.{SIX}@okpay",
    "Rs.{AMT} spent on Credit Card ending {TAIL} at {STORE}. Available limit is Rs.{BAL}",
    "Card min amount due is Rs.{AMT}",
    "{SHOP} has requested Rs.{AMT}",
    "Special offer! win Rs.{AMT}",  # 25
    "Rs.{AMT} was not debited from A/c XX{TAIL}",
    "You paid €{AMT} to {STORE}",
    "A/c XX{TAIL} debited Rs.{AMT} mTFR/{PHONE}/{PAYER}",
    "Rs.{AMT} credited [NEFT-{PAYER}-{REF}]",
    "Refund of Rs.{AMT} received at 10:45. Bal Rs.{BAL}",  # 30
    "Your autopay mandate was declined for Rs.{AMT}",
)
SENDER = "case o_custkey % 3 when 0 then 'VM-ALPHBK' when 1 then 'AD-BETABK-S' else 'JD-GAMCRD' end"
USER, MESSAGE = "concat('u', cast(o_custkey % 50 as {S}))", "concat('m', cast(o_orderkey as {S}))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def _from(orders: DataFrame, body: str) -> DataFrame:
    return orders.selectExpr(USER.replace("{S}", "string") + " AS user_id", MESSAGE.replace("{S}", "string") + " AS msg_id", SENDER + " AS sender", body + " AS body", "o_orderdate AS ts")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; only where that is unset (tests), under a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="ledgerflow-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """The message table as Parquet in the shared folder, written once a session: messages are read, as they are elsewhere."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = shared_path(spark, name)
        made().repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
        _written[key] = path
    return spark.read.schema(schema.MESSAGE).parquet(_written[key])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shapes: debit, credit, card spend, one-time code, balance notice, mandate event."""
    mandate = (
        "concat('Your UPI-Mandate is successfully ', case when o_orderkey % 4 = 1 then 'cancelled' else 'created' end, ' towards ', "
        + MACROS["SERVICE"].replace("{S}", "string") + ", ' for ', " + MACROS["AMT"].replace("{S}", "string") + ", ' from A/c XX', " + MACROS["TAIL"].replace("{S}", "string") + ", '. UMN:', substring(sha2(cast(o_custkey as string),256),1,16), '@abc')"
    )
    whens = " ".join(f"when {i} then {expand(t, 'string')}" for i, t in enumerate(SHAPES))
    return _stored(spark, sf_dir, "messages", lambda: _from(_orders(spark, sf_dir), f"case o_orderkey % 6 {whens} else {mandate} end"))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of ``RICH``."""
    whens = " ".join(f"when {i} then {expand(t, 'string')}" for i, t in enumerate(RICH))
    return _stored(spark, sf_dir, "rich-messages", lambda: _from(_orders(spark, sf_dir), f"case o_orderkey % {len(RICH)} {whens} end"))


def case(fields: dict[int, str], other: str = "NULL", n: int = len(RICH)) -> str:
    """The value of each shape, as SQL for the oracles' engine."""
    return f"CASE o_orderkey % {n} " + " ".join(f"WHEN {k} THEN {sql(v)}" for k, v in fields.items()) + f" ELSE {other} END"


ID = "concat('m', cast(o_orderkey as varchar))"
WHO = "concat('u', cast(o_custkey % 50 as varchar))"
