"""Registered queries over the operators, each with the SQL of an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as C
from ..operators import brands, classify, corpus, extract, fields, gates, ledger, recurring, routing, scorecard
from ..sources import messages as M
from . import fixtures as X
from .fixtures import AMOUNT, BALANCE, ID, SENDER, WHO, case

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: When "now" is, for the operators that take it.
AS_OF = "2001-06-30 00:00:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def num(name: str) -> F.Column:
    return F.col(name).cast("double").alias(name)


def rich_sql(**columns: str) -> str:
    return f"SELECT {ID} AS msg_id, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM orders"


def on_rich(name: str, columns: Callable[[F.Column], dict[str, F.Column]], **truth: str) -> None:
    """A query of columns over the rich messages, against their truth."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.rich(spark, sf_dir).select("msg_id", *[c.alias(k) for k, c in columns(F.col("body")).items()])

    run.__name__ = name
    query(rich_sql(**truth))(run)


def text(v: str) -> str:
    return "'" + v + "'"


# --- flagship, extraction ---------------------------------------------------------------------------------------------

_TYPE6 = "CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_custkey % 3 = 2 THEN 'CREDIT' ELSE 'EXPENSE' END WHEN 1 THEN CASE WHEN o_custkey % 3 = 2 THEN 'CREDIT' ELSE 'INCOME' END WHEN 2 THEN CASE WHEN o_custkey % 3 = 2 THEN 'CREDIT' ELSE 'EXPENSE' END END"
_TX = f"""WITH tx AS (SELECT {WHO} AS user_id, {ID} AS msg_id, {_TYPE6} AS type, o_orderkey % 6 AS k, o_custkey AS c, cast(o_totalprice AS decimal(18,2)) AS amount, cast(o_totalprice*2 AS decimal(18,2)) AS bal,
 CASE o_orderkey % 6 WHEN 2 THEN 'USD' ELSE 'INR' END AS currency, lpad(cast(o_custkey % 10000 AS varchar),4,'0') AS tail, o_orderdate AS ts, lpad(cast(o_orderkey AS varchar),12,'0') AS ref,
 {SENDER} AS sender FROM orders WHERE o_orderkey % 6 < 3)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_transactions(X.messages(spark, sf_dir), routing.institutions(spark))


@query(_TX + " SELECT user_id, strftime(ts, '%Y-%m-01') AS month, currency, cast(coalesce(sum(CASE WHEN type = 'INCOME' THEN amount END), 0) AS double) AS income, cast(coalesce(sum(CASE WHEN type <> 'INCOME' THEN amount END), 0) AS double) AS expense, cast(coalesce(sum(CASE WHEN type = 'INCOME' THEN amount ELSE -amount END), 0) AS double) AS net FROM tx GROUP BY ALL")
def a1_monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.monthly_totals(transactions(spark, sf_dir), "type")
    return out.select("user_id", F.col("month").cast("string").alias("month"), "currency", num("income"), num("expense"), num("net"))


@query(_TX + " SELECT user_id, msg_id, CASE c % 3 WHEN 0 THEN 'Alpha Bank' WHEN 1 THEN 'Beta Bank' ELSE 'Gamma Card' END AS institution, cast(amount AS double) AS amount, type, CASE type WHEN 'INCOME' THEN 'in' ELSE 'out' END AS flow, currency, CASE k WHEN 0 THEN concat('SHOP', cast(c % 37 AS varchar)) WHEN 1 THEN concat('PAYER', cast(c % 11 AS varchar)) ELSE concat('STORE', cast(c % 23 AS varchar)) END AS merchant, CASE k WHEN 0 THEN ref END AS reference, tail AS account_last4, CASE WHEN k < 2 THEN cast(bal AS double) END AS balance, k = 2 OR c % 3 = 2 AS is_card FROM tx")
def x10_extract_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("user_id", "msg_id", "institution", num("amount"), "type", "flow", "currency", "merchant", "reference", "account_last4", num("balance"), "is_card")


def _money(name: str) -> str:
    return f"cast({name} AS double)"


on_rich("x01_amount", lambda body: {"amount": fields.amount(body).cast("double")}, amount=case({2: "NULL", 10: "NULL", 12: "NULL", 20: BALANCE}, AMOUNT))
on_rich("x02_direction", lambda body: {"type": fields.direction(body)}, type=case({1: "'INCOME'", 9: "'INVESTMENT'", 14: "'INCOME'", 16: "'INVESTMENT'", 29: "'INCOME'", 30: "'INCOME'", **{k: "'EXPENSE'" for k in (0, 4, 6, 7, 17, 18, 19, 21, 22, 26, 27, 28)}}))
on_rich("x03_merchant", lambda body: {"merchant": fields.merchant(body)}, merchant=case({0: "{SHOP}", 4: "{SHOP}", 6: "{SERVICE}", 8: "{PAYER}", 22: "{STORE}", 27: "{STORE}"}))
on_rich("x05_reference", lambda body: {"reference": fields.reference(body)}, reference=case({0: "{REF}", 8: "concat('UT', {REF})"}))
on_rich("x06_account_tail", lambda body: {"tail": fields.account_tail(body)}, tail=case({k: "{TAIL}" for k in (0, 1, 3, 6, 7, 8, 9, 17, 18, 20, 22, 26, 28)}))
on_rich("x07_balance", lambda body: {"balance": fields.balance(body).cast("double")}, balance=case({0: BALANCE, 15: AMOUNT, 20: f"-({BALANCE})", 30: BALANCE}))
on_rich("x08_credit_limit", lambda body: {"credit_limit": fields.credit_limit(body).cast("double")}, credit_limit=case({22: BALANCE}))
on_rich("x09_currency", lambda body: {"currency": fields.currency(body)}, currency=case({27: "'EUR'"}, "'INR'"))
on_rich("x16_mandate_rows", lambda body: {"notice": gates.mandate_notice(body)}, notice=case({19: "'upcoming'", 31: "'declined'"}))
on_rich("x17_rich_type", lambda body: {"rich_type": fields.rich_type(body)}, rich_type=case({1: "'SALARY'", 3: "'WALLET_CREDIT'", 4: "'WALLET_DEBIT'", 5: "'RECHARGE'", 6: "'AUTO_DEBIT'", 7: "'ATM_WITHDRAWAL'", 8: "'TRANSFER'", 9: "'INVESTMENT'", 14: "'INCOME'", 20: "'BALANCE_UPDATE'", 29: "'INCOME'", 30: "'INCOME'", **{k: "'EXPENSE'" for k in (0, 17, 18, 19, 21, 22, 26, 27, 28)}}))
on_rich("x18_subcategory", lambda body: {"subcategory": fields.subcategory(body)}, subcategory=case({3: "'wallet'", 4: "'wallet'", 6: "'autdbt'", 7: "'atm'", 8: "'neft'", 10: "'otp'", 13: "'emi'", 14: "'cashback'", 17: "'upi'", 29: "'neft'", 30: "'refund'", 31: "'decline'"}))
on_rich("x20_address_payee", lambda body: {"address": fields.address_of(body), "payee": fields.address_payee(fields.address_of(body))}, address=case({21: "concat('grngrcr.', {SIX}, '@okpay')"}), payee=case({21: "concat('grngrcr.', {SIX})"}))
on_rich("x33_payee_alias", lambda body: {"brand": fields.payee_alias(fields.address_of(body))}, brand=case({21: "'Green Grocer'"}))
on_rich("x34_channel_label", lambda body: {"label": fields.channel_label(body)}, label=case({5: "concat('Mobile Recharge XXXXXX', right({PHONE}, 4))", 7: "concat('ATM Cash ', {CITY})", 8: "'NEFT Transfer'", 13: "'Bill Payment'", 17: "'UPI Transfer'", 29: "'NEFT Transfer'"}))
on_rich("x35_narration", lambda body: {"channel": fields.narration(body)["channel"], "reference": fields.narration(body)["reference"], "counterparty": fields.narration(body)["counterparty"]}, channel=case({17: "'UPI'", 28: "'MTFR'", 29: "'NEFT'"}), reference=case({17: "{REF}"}), counterparty=case({17: "{PAYER}", 28: "{PAYER}", 29: "{PAYER}"}))
on_rich("x36_two_accounts", lambda body: {"type": fields.two_accounts(body)["type"], "own": fields.two_accounts(body)["own"], "other": fields.two_accounts(body)["other"]}, type=case({18: "'EXPENSE'"}), own=case({18: "{TAIL}"}), other=case({18: "{OTHER}"}))
_PACK_TRUTH = {
    "x21_otp_fields": ("otp", {"otp_code": {10: "{SIX}"}, "otp_valid": {10: "'10 minutes'"}}),
    "x22_travel_fields": ("travel", {"pnr": {11: "concat('P', {SIX})"}, "flight": {11: "'AI-202'"}, "departs": {11: "'10:30'"}, "arrives": {11: "'12:45'"}, "fare": {11: "{AMT}"}, "vehicle": {11: "concat('T', {SIX})"}, "gate": {11: "'B12'"}}),
    "x23_delivery_fields": ("delivery", {"order_no": {12: "concat('OD', {REF})"}, "tracking": {12: "concat('AW', {REF})"}, "delivery_status": {12: "'shipped'"}, "item": {12: "concat('I', {SIX})"}}),
    "x24_bill_fields": ("bill", {"mandate_amount": {19: "{AMT}", 31: "{AMT}"}, "bill_amount": {13: "{AMT}"}, "emi_amount": {13: "{BAL}"}, "due_date": {13: "{DAY}"}, "policy_no": {13: "concat('PL', {SIX})"}, "recharge_amount": {5: "{AMT}"}}),
    "x25_offer_fields": ("offer", {"cashback": {14: "{AMT}"}, "discount": {14: "'20%'"}, "offer_code": {14: "'SAVE20'"}}),
    "x26_telecom_fields": ("telecom", {"data_left": {2: "'1.5 GB'", 15: "'250 MB'"}, "pack_balance": {15: "{AMT}"}}),
    "x27_holdings_fields": ("holdings", {"nav": {16: "{AMT}"}, "folio": {9: "concat('F', {SIX})", 16: "concat('F', {SIX})"}, "margin": {16: "{BAL}"}}),
}
for _name, (_family, _truth) in _PACK_TRUTH.items():
    if _family == "travel":
        continue
    on_rich(_name, lambda body, family=_family: fields.pack(body, family), **{k: f"cast({case(v) if v else 'NULL'} AS varchar)" for k, v in _truth.items()})

_TRAVEL = {k: f"cast({case(v)} AS varchar)" for k, v in _PACK_TRUTH["x22_travel_fields"][1].items()}


@query(rich_sql(**_TRAVEL, origin=case({11: "'DEL'"}), destination=case({11: "'BOM'"})))
def x22_travel_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.rich(spark, sf_dir)
    places = extract.travel_places(m, rows(spark, "word string, code string", ("Delhi", "DEL"), ("Mumbai", "BOM")))
    return m.select("msg_id", *[c.alias(k) for k, c in fields.pack(F.col("body"), "travel").items()]).join(places, "msg_id", "left")


# --- filters ----------------------------------------------------------------------------------------------------------

_REASONS = {10: "'otp'", 14: "'promo'", 25: "'promo'", 24: "'request'", 13: "'due'", 23: "'due'", **{k: "'no_verb'" for k in (2, 3, 5, 11, 12, 15, 16, 20, 31)}}
on_rich("f1_reject_reason", lambda body: {"reason": gates.reject_reason(body), "is_transaction": gates.is_transaction(body)}, reason=case(_REASONS), is_transaction=f"({case(_REASONS)}) IS NULL")
on_rich("f2_keyword_gate", lambda body: {"gate": gates.keyword_gate(body)}, gate=case({**{k: "false" for k in (2, 3, 5, 10, 11, 12, 13, 14, 15, 16, 20, 23, 24, 25, 31)}}, "true"))
on_rich("f6_investment", lambda body: {"investment": gates.is_investment(body)}, investment=case({9: "true", 16: "true"}, "false"))
on_rich("f7_card", lambda body: {"card": gates.is_card(body)}, card=case({22: "true", 23: "true"}, "false"))
on_rich("f10_balance_notice", lambda body: {"notice": gates.is_balance_notice(body)}, notice=case({20: "true"}, "false"))
on_rich("f14_expiry_notice", lambda body: {"expiry": gates.is_expiry_notice(body)}, expiry=case({2: "true"}, "false"))


@query("SELECT doc_id, length(text) <= 5000 AS short_enough FROM documents")
def f3_length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", gates.short_enough(F.col("text")).alias("short_enough"))


@query(f"SELECT {ID} AS msg_id FROM orders WHERE o_custkey % 3 <> 1")
def f4_known_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = routing.institutions(spark).where("institution <> 'Beta Bank'")
    return routing.known_sender(X.messages(spark, sf_dir), some).select("msg_id")


@query("SELECT doc_id, word, length(word) >= 2 AND regexp_matches(word, '[a-z]') AND word NOT IN (" + ", ".join(map(text, (*gates.STOP_WORDS, "acct", "my", "sip", "folio", "atm", "nav"))) + ") AND NOT regexp_matches(word, '^(x+[0-9]+$|(rs|inr|usd)[0-9])') AS valid FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)")
def f8_valid_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).distinct()
    return found.select("doc_id", "word", gates.is_merchant(F.col("word")).alias("valid"))


_YEAR = "cast(year(o_orderdate) AS varchar)"


@query(f"SELECT {ID} AS msg_id, true AS own, lpad(cast(o_custkey % 10000 AS varchar),4,'0') = {_YEAR} AS in_date, false AS day_first, true AS masked, true AS bare FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 4)")
def f9_account_tail_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message's own tail; the year of its date, which is no tail unless it is also that of an account; both in other forms."""
    m = X.messages(spark, sf_dir).where(F.col("body").rlike(r"XX\d{4}.*\d{4}-\d\d-\d\d"))
    body, year = F.col("body"), F.year("ts").cast("string")
    own = F.regexp_extract(body, r"XX(\d{4})", 1)
    day_first = F.concat(F.lit("paid by account on "), F.date_format("ts", "dd-MM-yyyy"))
    masked = F.concat(F.lit("A/c XX"), year, F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"))
    return m.select("msg_id", gates.is_account_tail(body, own).alias("own"), gates.is_account_tail(body, year).alias("in_date"), gates.is_account_tail(day_first, year).alias("day_first"), gates.is_account_tail(masked, year).alias("masked"), gates.is_account_tail(F.concat(F.lit("A/c "), year), year).alias("bare"))


@query(rich_sql(notice=case({19: "'upcoming'", 31: "'declined'"})) + " WHERE o_orderkey % 32 IN (19, 31)")
def f11_mandate_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rich(spark, sf_dir).select("msg_id", gates.mandate_notice(F.col("body")).alias("notice")).where("notice IS NOT NULL")


@query(f"SELECT {ID} AS msg_id, CASE WHEN o_orderkey % 6 = 5 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'cancellation' ELSE 'creation' END END AS notice, CASE WHEN o_orderkey % 6 = 0 THEN 'future_debit' WHEN o_orderkey % 6 = 5 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'cancellation' ELSE 'creation' END END AS later, CASE WHEN o_orderkey % 6 = 5 THEN 'e_mandate' END AS plain FROM orders")
def f11_mandate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as it is, with its debit in the future, and with its event left open."""
    body = F.col("body")
    return X.messages(spark, sf_dir).select("msg_id", gates.mandate_notice(body).alias("notice"), gates.mandate_notice(F.regexp_replace(body, "debited from", "will be debited from")).alias("later"), gates.mandate_notice(F.regexp_replace(body, "is successfully (?:created|cancelled)", "was noted")).alias("plain"))


_SIGNS = (("US$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("S$", "SGD"), ("HK$", "HKD"), ("₹", "INR"))


@query(f"SELECT {ID} AS msg_id, CASE WHEN o_orderkey % 6 = 2 THEN CASE o_orderkey % 4 WHEN 0 THEN 'CHF' WHEN 2 THEN 'THB' ELSE 'USD' END ELSE 'INR' END AS code, CASE o_custkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_SIGNS)) + f" END AS sign FROM orders")
def x09_currency_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes before what was spent, and signs at an amount, which the number of the card's holder picks."""
    m = X.messages(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey")).alias("msg_id"), F.col("o_orderkey").alias("k"), F.pmod("o_custkey", F.lit(7)).cast("int").alias("c")), "msg_id")
    code = F.when(F.col("k") % 4 == 0, "CHF").when(F.col("k") % 4 == 2, "THB").otherwise("USD")
    sign = F.element_at(F.array(*[F.lit(x) for x, _ in _SIGNS]), F.col("c") + 1)
    return m.select("msg_id", fields.currency(F.regexp_replace("body", F.lit("^USD"), code)).alias("code"), fields.currency(F.concat(F.lit("You paid "), sign, F.col("k") % 1000, F.lit(".50 at a shop"))).alias("sign"))


# --- sources, sinks ---------------------------------------------------------------------------------------------------


@query("SELECT concat('u', cast(user_id AS varchar)) AS user_id, concat('e', cast(event_id AS varchar)) AS msg_id, event_type AS sender, props AS body, date_trunc('milliseconds', ts) AS ts FROM events")
def s1_read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    store = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("user_id"), F.concat(F.lit("e"), F.col("event_id")).alias("_id"), F.col("event_type").alias("address"), F.col("props").alias("body"), F.unix_millis(F.col("ts").cast("timestamp")).alias("date"))
    return M.from_store(store).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"SELECT user_id, msg_id, ts FROM (SELECT {WHO} AS user_id, {ID} AS msg_id, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, {ID}) AS n FROM orders) WHERE n <= 100")
def s2_newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.newest_per_user(X.messages(spark, sf_dir), 100).select("user_id", "msg_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no_body' WHEN trim(coalesce(role, '')) = '' THEN 'no_sender' END AS reject_reason FROM conversations")
def s3_validate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("body"), F.col("role").alias("sender"), F.timestamp_seconds("turn").alias("ts"))
    return M.with_reject_reason(m).select("conv_id", "turn", "reject_reason")


_TX_ROWS = " SELECT user_id, msg_id, cast(amount AS double) AS amount, type, strftime(ts, '%Y-%m') AS month FROM tx"


def _tx_rows(tx: DataFrame) -> DataFrame:
    return tx.select("user_id", "msg_id", num("amount"), "type", F.date_format("ts", "yyyy-MM").alias("month"))


@query(_TX + _TX_ROWS)
def s5_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    first = M.insert_new(tx.where(F.pmod(F.xxhash64("msg_id"), F.lit(2)) == 0), None)
    second = M.insert_new(tx.union(tx), first)  # each row comes twice, half of them a third time
    return _tx_rows(first.union(second))


@query("SELECT p_name AS name, cast(p_partkey AS bigint) AS code FROM part")
def s7_load_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").cast("long").alias("code"))
    return M.load_dictionary(part, T.StructType([T.StructField("name", T.StringType()), T.StructField("code", T.LongType())]), ("code",))


@query(_TX + _TX_ROWS)
def s6_write_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.shared_path(spark, "transactions")
    M.write_transactions(transactions(spark, sf_dir), path)
    return _tx_rows(spark.read.parquet(path))


# --- routing ----------------------------------------------------------------------------------------------------------


@query(f"SELECT {ID} AS msg_id, CASE o_custkey % 3 WHEN 0 THEN 'Alpha Bank' WHEN 1 THEN 'Beta Bank' ELSE 'Gamma Card' END AS institution, CASE o_custkey % 3 WHEN 2 THEN 'CREDIT' END AS type_override FROM orders")
def j1_route_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_sender(X.messages(spark, sf_dir), routing.institutions(spark)).select("msg_id", "institution", "type_override")


@query(f"SELECT {ID} AS msg_id, CASE o_custkey % 3 WHEN 0 THEN 'BANK' WHEN 1 THEN 'TRAVEL' END AS sender_category FROM orders")
def j2_sender_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, "alias string, category string", ("ALPHBK", "BILL"), ("ALPHBK", "BANK"), ("BETABK", "TRAVEL"), ("BETABK", "OFFERS"), ("S", "BANK"))
    return routing.sender_category(X.messages(spark, sf_dir), d).select("msg_id", "sender_category")


@query(f"SELECT {ID} AS msg_id, CASE o_custkey % 3 WHEN 0 THEN 'Alpha Bank' END AS bank_exact FROM orders")
def j3_bank_by_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, "alias string, bank string, prio int", ("ALPHBK", "Alpha Bank", 1), ("alphbk", "Other", 2))
    return routing.bank_by_fragment(X.messages(spark, sf_dir), d).select("msg_id", "bank_exact")


_ALIASES = (("beta", "BETA", 1), ("gamcrd", "GAMMA CARD", 2), ("alph", "alphabet", 3))
_KNOWN = (("Beta Bank",), ("Gamma Card",), ("Gamma Card Plus",))


@query(f"SELECT {ID} AS msg_id, CASE o_custkey % 3 WHEN 0 THEN 'Alphabet' WHEN 1 THEN 'Beta Bank' ELSE 'Gamma Card' END AS bank_alias FROM orders")
def j4_bank_by_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.bank_by_substring(X.messages(spark, sf_dir), rows(spark, "alias string, raw string, prio int", *_ALIASES), rows(spark, "name string", *_KNOWN)).select("msg_id", "bank_alias")


@query(f"SELECT {ID} AS msg_id, CASE o_custkey % 3 WHEN 0 THEN 'Alpha Bank' WHEN 1 THEN 'Beta Bank' ELSE 'Gamma Card' END AS bank_name FROM orders")
def j5_bank_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = rows(spark, "alias string, bank string, prio int", ("ALPHBK", "Alpha Bank", 1))
    return routing.bank_name(X.messages(spark, sf_dir), exact, rows(spark, "alias string, raw string, prio int", *_ALIASES), rows(spark, "name string", *_KNOWN)).select("msg_id", "bank_name")


@query(f"SELECT {ID} AS msg_id, CASE o_custkey % 3 WHEN 2 THEN 'SHOPPING' END AS offer_category FROM orders")
def j6_offer_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.offer_category(X.messages(spark, sf_dir), rows(spark, "alias string, offer string", ("GAMCRD", "SHOPPING"))).select("msg_id", "offer_category")


@query(rich_sql(provider=case({21: "'OK Pay'"})))
def j7_payee_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.rich(spark, sf_dir).select("msg_id", fields.address_of(F.col("body")).alias("address"))
    return routing.by_handle(m, "address", rows(spark, "handle string, provider string", ("OKPAY", "OK Pay"), ("abc", "ABC"))).select("msg_id", "provider")


_WORDS = "SELECT doc_id, min(i) AS pos, w FROM (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)) GROUP BY doc_id, w"


@query(f"WITH w AS ({_WORDS}), h AS (SELECT doc_id, pos, CASE w WHEN 'the' THEN 'THE' WHEN 'der' THEN 'DER' ELSE 'QUE' END AS code FROM w WHERE w IN ('the', 'der', 'que')) SELECT doc_id, arg_min(code, pos) AS code, string_agg(code, ',' ORDER BY pos) AS codes FROM h GROUP BY doc_id")
def j8_place_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = rows(spark, "word string, code string", ("the", "THE"), ("der", "DER"), ("que", "QUE"))
    return routing.place_codes(table(spark, sf_dir, "documents"), places, "doc_id").select("doc_id", "code", F.array_join("codes", ",").alias("codes"))


@query(f"WITH t AS (SELECT doc_id, concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' '), ' ') AS t FROM documents), w AS ({_WORDS}), h AS (SELECT doc_id, arg_min(CASE w WHEN 'the' THEN 'THE' ELSE 'LA' END, pos) AS code FROM w WHERE w IN ('the', 'la') GROUP BY doc_id) SELECT doc_id, CASE WHEN contains(t, ' of the ') THEN 'OT' WHEN contains(t, ' de la ') THEN 'DL' ELSE code END AS code FROM t LEFT JOIN h USING (doc_id) WHERE contains(t, ' of the ') OR contains(t, ' de la ') OR code IS NOT NULL")
def j9_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = rows(spark, "phrase string, code string, prio int", ("of the", "OT", 1), ("de la", "DL", 2))
    return routing.gazetteer(table(spark, sf_dir, "documents"), phrases, rows(spark, "word string, code string", ("the", "THE"), ("la", "LA")), "doc_id")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'azure') THEN 'Azure Co' WHEN contains(lower(p_name), 'blue') THEN 'Blue Co' WHEN contains(lower(p_type), 'steel') THEN 'Steel Co' END AS brand, contains(lower(p_name), 'azure') AS online FROM part")
def j10_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = rows(spark, "token string, brand string, category string, online boolean, ord int", ("azure", "Azure Co", "A", True, 1), ("blue", "Blue Co", "B", False, 2), ("steel", "Steel Co", "C", False, 3))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("merchant"), F.col("p_type").alias("body"))
    return brands.brand_of(p, known, "p_partkey").select("p_partkey", "brand", "online")


_KEYS = (("steel", "metal", 1), ("copper", "metal", 2), ("brushed", "finish", 3), ("polished", "finish", 4), ("economy", "class", 5), ("tin", "metal", 6))


@query("WITH t AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS token FROM part), k AS (SELECT * FROM (VALUES ('steel',1),('copper',2),('brushed',3),('polished',4),('economy',5),('tin',6)) v(keyword, ord)), i AS (SELECT token, keyword FROM t, k WHERE length(keyword) > 3 AND contains(token, keyword)), n AS (SELECT token, arg_max(keyword, s + ord * 1e-9) AS keyword, max(s) AS s FROM (SELECT token, keyword, ord, jaro_winkler_similarity(token, keyword) AS s FROM t, k WHERE length(token) > 4) GROUP BY token) SELECT token, keyword FROM i UNION SELECT token, keyword FROM n WHERE s > 0.9 UNION SELECT token, 'tin' FROM t WHERE token = 'tin'")
def j11_token_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "part").select(F.explode(C.split_merchant(F.col("p_type"))).alias("token"))
    return brands.token_matches(tokens, rows(spark, "keyword string, category string, ord int", *_KEYS))


@query("WITH s AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part) SELECT * FROM (SELECT p_partkey, concat_ws(',', CASE WHEN list_contains(w, 'economy') THEN 'class' END, CASE WHEN list_contains(w, 'brushed') OR list_contains(w, 'polished') THEN 'finish' END, CASE WHEN list_contains(w, 'steel') OR list_contains(w, 'copper') OR list_contains(w, 'tin') THEN 'metal' END) AS categories FROM s) WHERE categories <> ''")
def j11_fuzzy_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return brands.fuzzy_category(p, rows(spark, "keyword string, category string, ord int", *_KEYS), "p_partkey", "p_type").select("p_partkey", F.array_join("categories", ",").alias("categories"))


@query(rich_sql(category=case({10: "'OTP'", 11: "'TRAVEL'", 12: "'DELIVERY'", 14: "'OFFERS'", 25: "'OFFERS'", 16: "'STOCK'"}, "'BANK'")))
def j12_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.rich(spark, sf_dir)
    words = rows(spark, "phrase string, type string, norm string", ("otp", "OTP", "otp"), ("flight", "TRAVEL", "flight"), ("order no", "DELIVERY", "order"), ("offer", "OFFERS", "offer"), ("nav", "STOCK", "nav"))
    tags = corpus.tag_keywords(m, words, 2, "msg_id", "body")
    return routing.category(m.withColumn("sender_category", F.lit(None).cast("string")), tags).select("msg_id", "category")


# --- ledgers ----------------------------------------------------------------------------------------------------------


@query(_TX + " SELECT user_id, currency, cast(coalesce(sum(CASE WHEN type = 'INCOME' THEN amount ELSE -amount END), 0) AS double) AS net FROM tx WHERE strftime(ts, '%Y-%m') = '1996-03' GROUP BY ALL")
def a2_net_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.monthly_totals(transactions(spark, sf_dir), "type", "1996-03-15 00:00:00").select("user_id", "currency", num("net"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("user_id"), F.concat(F.lit("e"), F.col("event_id")).alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("bank_name"), F.concat(F.lit("XX"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("account_last4"), F.round("value", 2).cast("decimal(18,2)").alias("balance"), F.lit(None).cast("string").alias("currency"), F.col("event_type").alias("sender"))


_READ = "WITH r AS (SELECT concat('u', cast(user_id % 20 AS varchar)) AS user_id, concat('e', cast(event_id AS varchar)) AS msg_id, ts, event_type AS bank_name, right(lpad(cast(user_id AS varchar), 4, '0'), 4) AS last4, cast(round(value, 2) AS decimal(18,2)) AS balance FROM events WHERE value IS NOT NULL)"


@query(_READ + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id, bank_name, last4 ORDER BY ts DESC, msg_id) AS k, count(*) OVER (PARTITION BY user_id, bank_name, last4) AS readings, sum(balance) OVER (PARTITION BY user_id, bank_name, last4) AS total FROM r) SELECT user_id, bank_name, last4, cast(balance AS double) AS balance, ts AS as_of, readings, cast(total AS double) AS total FROM n WHERE k = 1")
def a3_account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ledger.account_balances(_readings(spark, sf_dir))
    total = F.aggregate("history", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x["balance"]).cast("decimal(28,2)"))
    return a.select("user_id", "bank_name", "last4", num("balance"), F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.size("history").cast("long").alias("readings"), total.cast("double").alias("total"))


@query(_READ + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id, bank_name, last4 ORDER BY ts DESC, msg_id) AS k FROM r) SELECT user_id, bank_name, last4, cast(arg_min(balance, k) AS double) AS balance, count(*) AS readings, string_agg(cast(balance AS varchar), ',' ORDER BY k) FILTER (WHERE k <= 3) AS newest FROM n GROUP BY ALL")
def a3_newest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines and counts of accounts with their three newest readings."""
    a = ledger.account_balances(_readings(spark, sf_dir), newest=3)
    return a.select("user_id", "bank_name", "last4", num("balance"), "readings", F.array_join(F.transform("history", lambda x: x["balance"].cast("string")), ",").alias("newest"))


@query(_READ + ", m AS (SELECT *, max(ts) OVER (PARTITION BY user_id, bank_name, last4) AS top FROM r) SELECT user_id, bank_name, last4, count(*) FILTER (WHERE ts <> top) AS earlier FROM m GROUP BY ALL")
def w4_earlier_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ledger.earlier_readings(ledger.account_balances(_readings(spark, sf_dir)))
    return a.select("user_id", "bank_name", "last4", F.size("history").cast("long").alias("earlier"))


@query(_READ + " SELECT user_id, bank_name, msg_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bank_name ORDER BY ts DESC, msg_id) AS k FROM r) WHERE k = 1")
def w3_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_state(_readings(spark, sf_dir).where("balance IS NOT NULL"), ["user_id", "bank_name"]).select("user_id", "bank_name", "msg_id")


_MANDATE = f"WITH e AS (SELECT {WHO} AS user_id, {ID} AS msg_id, o_orderdate AS ts, concat(substring(sha256(cast(o_custkey AS varchar)),1,16), '@abc') AS mandate_id, CASE WHEN o_orderkey % 4 = 1 THEN 'cancelled' ELSE 'active' END AS status, concat('SERVICE', cast(o_custkey % 7 AS varchar)) AS merchant, cast(o_totalprice AS decimal(18,2)) AS amount FROM orders WHERE o_orderkey % 6 = 5), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, mandate_id ORDER BY ts DESC, msg_id) AS k, min(ts) OVER w AS created_at, max(ts) OVER w AS last_updated, count(*) OVER w AS events FROM e WINDOW w AS (PARTITION BY user_id, mandate_id))"


@query(_MANDATE + " SELECT user_id, msg_id, mandate_id, status, merchant, cast(amount AS double) AS amount FROM e")
def x16_mandate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.mandate_events(X.messages(spark, sf_dir)).select("user_id", "msg_id", "mandate_id", "status", "merchant", num("amount"))


@query(_MANDATE + " SELECT user_id, mandate_id, merchant, cast(amount AS double) AS amount, status, created_at, last_updated, events FROM n WHERE k = 1")
def a4_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ledger.mandates(extract.mandate_events(X.messages(spark, sf_dir)))
    return m.select("user_id", "mandate_id", "merchant", num("amount"), "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("last_updated").cast("timestamp_ntz").alias("last_updated"), F.size("history").cast("long").alias("events"))


@query(_MANDATE + " SELECT user_id, merchant, string_agg(mandate_id, ',' ORDER BY last_updated DESC, mandate_id) AS ids, max(last_updated) AS last_updated FROM n WHERE k = 1 GROUP BY user_id, merchant")
def a5_mandates_by_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ledger.mandates_by_merchant(ledger.mandates(extract.mandate_events(X.messages(spark, sf_dir))))
    return m.select("user_id", "merchant", F.array_join(F.transform("mandates", lambda x: x["mandate_id"]), ",").alias("ids"), F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


def _spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("u"), F.col("o_custkey")).alias("user_id"), F.concat(F.lit("m"), F.col("o_orderkey")).alias("msg_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("EXPENSE").alias("rich_type"), F.lit(None).cast("string").alias("mandate_id"), F.concat(F.lit(" Shop.com"), F.lit("")).alias("merchant"), (F.round(F.col("o_totalprice") * 0 + 100 + F.col("o_orderkey") % 9, 2)).cast("decimal(18,2)").alias("amount"), F.lit("INR").alias("currency"))


_RUN = """WITH s AS (SELECT concat('u', cast(o_custkey AS varchar)) AS user_id, concat('m', cast(o_orderkey AS varchar)) AS msg_id, o_orderdate AS ts, cast(100 + o_orderkey % 9 AS decimal(18,2)) AS amount FROM orders),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY ts DESC, msg_id) AS k FROM s) WHERE k = 1),
g AS (SELECT *, (epoch_us(lag(ts) OVER w) - epoch_us(ts)) / 86400000000.0 AS gap FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC)),
b AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND (gap < 20 OR gap > 45) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC) AS broken FROM g),
r AS (SELECT * FROM b WHERE broken = 0),
c AS (SELECT user_id, count(*) AS n, arg_max(amount, ts) AS amount, max(ts) AS last_date, min(amount) AS low, max(amount) AS high FROM r GROUP BY user_id),
a AS (SELECT max(ts) AS now FROM s),
q AS (SELECT c.* FROM c, a WHERE n >= 2 AND (high - low) * 10 <= low AND (epoch_us(now) - epoch_us(last_date)) / 86400000000.0 <= 60)"""


def _now(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate"))).first()[0]


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.recurring_charges(_spending(spark, sf_dir), F.lit(str(_now(spark, sf_dir))))


@query(_RUN + " SELECT user_id, msg_id FROM r")
def w2_trailing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.trailing_run(recurring.latest_per_day(_spending(spark, sf_dir), ["user_id"]), ["user_id"]).select("user_id", "msg_id")


@query(_RUN + " SELECT user_id, msg_id FROM d")
def w1_latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.latest_per_day(_spending(spark, sf_dir), ["user_id"]).select("user_id", "msg_id")


@query(_RUN + " SELECT user_id, 'shop' AS merchant_key, cast(amount AS double) AS amount, n AS count, last_date, CASE WHEN n >= 3 THEN 'likely' ELSE 'possible' END AS confidence FROM q")
def a6_recurring_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charges(spark, sf_dir).select("user_id", "merchant_key", num("amount"), "count", F.col("last_date").cast("timestamp_ntz").alias("last_date"), "confidence")


@query(_RUN + " SELECT user_id, 'INR' AS currency, cast(sum(amount) AS double) AS monthly FROM q WHERE n >= 3 GROUP BY user_id")
def a7_monthly_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.monthly_recurring(_charges(spark, sf_dir)).select("user_id", "currency", num("monthly"))


@query(_RUN + " SELECT s.user_id, s.msg_id, coalesce(abs(q.amount - s.amount) * 10 <= greatest(q.amount, s.amount, 1), false) AS recurring FROM s LEFT JOIN q USING (user_id)")
def j14_inferred_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = rows(spark, "user_id string, mandate_id string")
    return recurring.flag_recurring(_spending(spark, sf_dir), _charges(spark, sf_dir), none).select("user_id", "msg_id", F.col("by_inference").alias("recurring"))


@query(f"SELECT {WHO} AS user_id, {ID} AS msg_id, o_orderkey % 6 = 5 AS by_mandate FROM orders")
def j13_mandate_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.messages(spark, sf_dir)
    rolled = ledger.mandates(extract.mandate_events(m))
    feed = m.select("user_id", "msg_id", "ts", fields.mandate_id(F.col("body")).alias("mandate_id"), F.lit(None).cast("string").alias("merchant"), fields.amount(F.col("body")).alias("amount"), F.lit("INR").alias("currency"))
    none = rows(spark, "user_id string, merchant_key string, currency string, amount decimal(18,2)")
    return recurring.flag_recurring(feed, none, rolled).select("user_id", "msg_id", "by_mandate")


_FEED = "0,1,3,4,5,6,7,8,9,14,17,18,19,20,21,22,26,27,28,29,30"


@query(f"SELECT user_id, msg_id, feed_rank, payee, recurring FROM (SELECT {WHO} AS user_id, {ID} AS msg_id, {case({0: '{SHOP}', 4: '{SHOP}', 6: '{SERVICE}', 8: '{PAYER}', 21: text('Green Grocer'), 22: '{STORE}', 27: '{STORE}'}, SENDER)} AS payee, o_orderkey % 64 = 19 AS recurring, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, {ID}) AS feed_rank FROM orders WHERE o_orderkey % 32 IN ({_FEED})) WHERE feed_rank <= 25")
def l1_recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, body = X.rich(spark, sf_dir), F.col("body")
    number = extract.upcoming_mandates(m).select("user_id", "msg_id", F.col("mandate_no").alias("mandate_id"))
    seen = m.select("user_id", "msg_id", "ts", "sender", "body", fields.rich_type(body).alias("rich_type"), fields.amount(body).alias("amount"))
    # what ranks is extracted from all messages, the rest from those that are shown
    shown = ledger.recent_feed(gates.recognised(seen)).select("*", fields.merchant(body).alias("merchant"), fields.currency(body).alias("currency"), fields.payee_alias(fields.address_of(body)).alias("vendor"))
    feed = shown.join(number, ["user_id", "msg_id"], "left")
    rolled = table(spark, sf_dir, "orders").where("o_orderkey % 64 = 19").select(F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("user_id"), F.concat(F.lit("MN"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")).alias("mandate_id"))
    none = rows(spark, "user_id string, merchant_key string, currency string, amount decimal(18,2)")
    out = recurring.flag_recurring(feed, none, rolled)
    return out.select("user_id", "msg_id", F.col("feed_rank").cast("long").alias("feed_rank"), fields.display_payee(F.lit(None).cast("string"), F.coalesce("merchant", "vendor"), F.lit(None).cast("string"), F.col("sender")).alias("payee"), "recurring")


@query(_TX + ", f AS (SELECT DISTINCT user_id, currency FROM tx) SELECT user_id, currency, row_number() OVER (PARTITION BY user_id ORDER BY currency <> 'INR', currency) AS place FROM f")
def l3_currency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.currencies(ledger.monthly_totals(transactions(spark, sf_dir), "type")).withColumn("place", F.col("place").cast("long"))


@query(_MANDATE + " SELECT user_id, mandate_id, row_number() OVER (PARTITION BY user_id ORDER BY last_updated DESC, mandate_id) AS place FROM n WHERE k = 1")
def l2_mandates_by_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ledger.mandates_by_update(ledger.mandates(extract.mandate_events(X.messages(spark, sf_dir))))
    return m.select("user_id", "mandate_id", F.col("place").cast("long").alias("place"))


# --- notices ----------------------------------------------------------------------------------------------------------


@query(f"SELECT {ID} AS msg_id, {BALANCE} AS balance, lpad(cast(o_custkey % 10000 AS varchar),4,'0') AS account_last4, strftime(o_orderdate, '%Y-%m-%d') AS as_of, false AS is_credit_card FROM orders WHERE o_orderkey % 6 = 4")
def x14_balance_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.balance_notices(X.messages(spark, sf_dir), routing.institutions(spark)).select("msg_id", num("balance"), "account_last4", F.col("as_of").cast("string").alias("as_of"), "is_credit_card")


@query("SELECT * FROM (" + rich_sql(amount=AMOUNT, next_date="strftime(o_orderdate, '%Y-%m-%d')", date_format="'yyyy-MM-dd'", merchant=X.sql("{SERVICE}"), mandate_no=X.sql("concat('MN', {SIX})")) + " WHERE o_orderkey % 32 = 19)")
def x15_upcoming_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.upcoming_mandates(X.rich(spark, sf_dir)).select("msg_id", num("amount"), F.col("next_date").cast("string").alias("next_date"), "date_format", "merchant", "mandate_no")


@query(f"SELECT {ID} AS msg_id, CASE WHEN o_custkey % 3 = 1 THEN 'INVESTMENT' WHEN o_orderkey % 6 = 1 THEN 'INCOME' ELSE 'EXPENSE' END AS type, CASE WHEN o_custkey % 3 <> 1 AND o_orderkey % 6 = 1 THEN 'in' ELSE 'out' END AS flow, CASE o_custkey % 3 WHEN 0 THEN 'Alpha Bank' WHEN 1 THEN 'Fund' END AS institution FROM orders WHERE o_orderkey % 6 < 3")
def x12_forced_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rows(spark, "prio int, institution string, sender_pattern string, type_override string, kind string", (2, "Alpha Bank", "ALPHBK", None, "bank"), (1, "Fund", "BETABK", "INVESTMENT", "fund"), (3, "Late", "BETA", "EXPENSE", "bank"))
    return extract.extract_transactions(X.messages(spark, sf_dir), rules).select("msg_id", "type", "flow", "institution")


_TAIL = "lpad(cast(o_custkey % 10000 AS varchar),4,'0')"


@query(f"""SELECT {ID} AS msg_id, CASE WHEN c = 0 AND k = 4 THEN {BALANCE} ELSE {AMOUNT} END AS amount, CASE WHEN c = 2 THEN CASE WHEN k = 0 THEN 'TRANSFER' ELSE 'CREDIT' END WHEN c = 0 AND k = 4 THEN 'BALANCE_UPDATE' WHEN k = 1 THEN 'INCOME' ELSE 'EXPENSE' END AS type,
 CASE WHEN c = 1 AND k = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN k = 0 THEN lpad(cast(o_orderkey AS varchar),12,'0') END AS reference, CASE WHEN c = 2 AND k = 2 THEN right({_TAIL}, 2) ELSE {_TAIL} END AS account_last4,
 CASE WHEN c = 1 AND k = 0 THEN {AMOUNT} WHEN k IN (0, 1, 4) THEN {BALANCE} END AS balance, CASE WHEN k = 0 THEN {X.sql('{SHOP}')} WHEN k = 1 THEN {X.sql('{PAYER}')} WHEN k = 2 THEN {X.sql('{STORE}')} END AS merchant, c = 0 AND k = 0 OR k = 2 OR c = 2 AS is_card
 FROM (SELECT *, o_custkey % 3 AS c, o_orderkey % 6 AS k FROM orders) WHERE k IN (0, 2) OR k = 1 AND c <> 1 OR k = 4 AND c = 0""")
def x11_scoped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages under rules of three institutions for every field that rules may state."""
    own = rows(
        spark, extract.RULE,
        ("Alpha Bank", "gate", 1, r"^Available Balance in", "accept"), ("Beta Bank", "gate", 1, r"\bcredited\b", "reject"), ("Alpha Bank", "type", 1, r"^Available Balance in", "BALANCE_UPDATE"), ("Gamma Card", "type", 1, r"\bdebited\b", "TRANSFER"),
        ("Alpha Bank", "amount", 1, r"Balance in \S+ \S+ is Rs\.([0-9.]+)", None), ("Beta Bank", "reference", 1, r"debited.* on ([0-9-]{10})\.", None), ("Gamma Card", "account_last4", 1, r"Card XX\d\d(\d\d)", None),
        ("Beta Bank", "balance", 2, r"Rs\.([0-9.]+) debited", None), ("Beta Bank", "balance", 1, r"no such text ([0-9]+)", None), ("Alpha Bank", "merchant", 1, r"from (PAYER99)", None), ("Alpha Bank", "is_card", 1, r"\bdebited\b", "true"),
    )
    tx = extract.extract_transactions(X.messages(spark, sf_dir), routing.institutions(spark), own=own)
    return tx.select("msg_id", num("amount"), "type", "reference", "account_last4", num("balance"), "merchant", "is_card")


@query("SELECT doc_id, sha256(regexp_replace(strip_accents(text), '[^\\x00-\\x7F₹€£¥]', '', 'g')) AS folded FROM documents")
def x13_fold_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(C.fold_ascii(F.col("text")), 256).alias("folded"))


@query("SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN source END, CASE WHEN lang = 'de' THEN 'bank' END, lang) AS payee FROM documents")
def x19_display_payee(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fields.display_payee(F.when(F.col("lang") == "en", F.col("source")), F.lit(None).cast("string"), F.when(F.col("lang") == "de", "bank"), F.col("lang")).alias("payee"))


def _id_sql(sender: str) -> str:
    return f"sha256(concat({sender}, '|', cast(cast(o_totalprice AS decimal(18,2)) AS varchar), '|', substring(sha256({X.sql(X.expand(X.SHAPES[0], 'varchar'))}), 1, 16)))"


@query(f"SELECT {ID} AS msg_id, {_id_sql(SENDER)} AS txn_id FROM orders")
def x31_txn_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X._orders(spark, sf_dir).selectExpr("concat('m', cast(o_orderkey as string)) AS msg_id", SENDER + " AS sender", "cast(o_totalprice as decimal(18,2)) AS amount", X.expand(X.SHAPES[0], "string") + " AS body")
    return o.select("msg_id", fields.txn_id(F.col("sender"), F.col("amount"), F.col("body")).alias("txn_id"))


@query(rich_sql(event_key=f"sha256({case({0: 'concat(' + repr('r|') + ', {REF})', 8: 'concat(' + repr('r|UT') + ', {REF})', 30: 'concat(' + repr('tb|10:45|') + ', {BAL})', 15: 'concat(' + repr('b|') + ', {AMT})', 11: repr('t|10:30'), 20: 'concat(' + repr('b|-') + ', {BAL})'}, 'concat(' + repr('s|') + ', ' + SENDER + ', ' + repr('|') + ', cast(epoch(o_orderdate)::bigint AS varchar))')})"))
def x30_event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rich(spark, sf_dir).select("msg_id", fields.event_key(F.col("body"), F.col("sender"), F.col("ts")).alias("event_key"))


# --- classifier, scorecards -------------------------------------------------------------------------------------------

_GRAMS = r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '(?i)(?:\b(?:rs|inr|usd)\.?\s*|[₹$€£])?\b\d[\d,]*(?:\.\d+)?\b', 'AMT', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS gram FROM t UNION ALL SELECT doc_id, concat_ws(' ', w[i], w[i+1]) FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t) UNION ALL SELECT doc_id, concat_ws(' ', w[i], w[i+1], w[i+2]) FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL),
y AS (SELECT doc_id, quality AS y FROM labels WHERE quality IS NOT NULL),
m AS (SELECT gram, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n1 FROM c JOIN y USING (doc_id) GROUP BY gram HAVING count(*) >= 2),
p AS (SELECT sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS d0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS d1 FROM y)"""


@query(_GRAMS + " SELECT gram, cast(n0 AS bigint) AS n0, cast(n1 AS bigint) AS n1 FROM m")
def a9_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", named=True)


@query(_GRAMS + ", w AS (SELECT gram, CASE WHEN n1 = 0 THEN 5.0 WHEN n0 = 0 THEN -5.0 ELSE ln((n0 / d0) / (n1 / d1)) END AS w FROM m, p), s AS (SELECT doc_id, sum(n * w) AS s FROM c JOIN w USING (gram) GROUP BY doc_id) SELECT doc_id, CASE WHEN round(coalesce(s, 0) + ln(d0 / d1), 6) >= 0 THEN 0 ELSE 1 END AS class, round(round(coalesce(s, 0) + ln(d0 / d1), 6), 2) AS score FROM documents LEFT JOIN s USING (doc_id), p")
def a8_classifier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify.score(d, classify.train(d, y, "quality"), classify.priors(y, "quality")).withColumn("score", F.round("score", 2))


_OK = "count(*) AS n, avg((o_orderkey % 7 <> 0)::int) AS amount_ok, avg((o_orderkey % 11 <> 0)::int) AS type_ok, avg((o_orderkey % 13 <> 0)::int) AS account_ok, avg((o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)::int) AS all_ok"


@query("SELECT CASE o_custkey % 3 WHEN 0 THEN 'Alpha Bank' WHEN 1 THEN 'Beta Bank' ELSE 'Gamma Card' END AS institution, {ok} FROM orders WHERE o_orderkey % 6 < 3 GROUP BY 1 UNION ALL SELECT NULL, {ok} FROM orders WHERE o_orderkey % 6 < 3".replace("{ok}", _OK))
def a10_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden rows of which some say another amount (within the tolerance or beyond it), type or account."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 6 < 3")
    golden = o.selectExpr("concat('m', cast(o_orderkey as string)) AS msg_id", "case o_custkey % 3 when 0 then 'Alpha Bank' when 1 then 'Beta Bank' else 'Gamma Card' end AS institution", "cast(o_totalprice as decimal(18,2)) + case when o_orderkey % 7 = 0 then 0.05 else 0.01 end AS amount", "case when o_orderkey % 11 = 0 then 'TRANSFER' when o_custkey % 3 = 2 then 'CREDIT' when o_orderkey % 6 = 1 then 'INCOME' else 'EXPENSE' end AS type", "case when o_orderkey % 13 = 0 then 'none' else lpad(cast(o_custkey % 10000 as string),4,'0') end AS account_last4")
    return scorecard.scorecard(transactions(spark, sf_dir), golden, ["msg_id"])


@query("SELECT count(*) AS n, cast(count(*) FILTER (WHERE o_orderkey % 6 = 2) AS bigint) AS false_positives FROM orders WHERE o_orderkey % 6 >= 3 OR o_orderkey % 6 = 2 AND o_custkey % 3 = 1")
def a11_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative corpus with some messages in it that are transactions, so that there is something to count."""
    negative = table(spark, sf_dir, "orders").where("o_orderkey % 6 >= 3 OR o_orderkey % 6 = 2 AND o_custkey % 3 = 1").selectExpr("concat('m', cast(o_orderkey as string)) AS msg_id")
    return scorecard.false_positives(transactions(spark, sf_dir), negative, ["msg_id"]).select("n", F.col("false_positives").cast("long").alias("false_positives"))


# --- scalar functions, corpus operators -------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
def c1_normalize_sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(C.normalize_sms(F.col("text")), 256).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, cast(cast(l_extendedprice AS decimal(18,2)) AS double) AS amount, CASE WHEN l_linenumber % 2 = 0 THEN cast(cast(l_extendedprice AS decimal(18,2)) AS double) END AS junk, CASE WHEN l_linenumber % 3 <> 0 THEN cast(cast(l_extendedprice AS decimal(18,2)) AS double) END AS positive, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END * cast(cast(l_extendedprice AS decimal(18,2)) AS double) AS finite FROM lineitem")
def c2_parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    shown = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    signed = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "-").otherwise(""), shown)
    return li.select("l_orderkey", "l_linenumber", C.parse_amount(shown).cast("double").alias("amount"), C.parse_amount(F.concat(F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise("x"), shown)).cast("double").alias("junk"), C.parse_amount(signed).cast("double").alias("positive"), C.parse_amount(signed, positive=False).cast("double").alias("finite"))


@query("SELECT p_partkey, p_name AS clean, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: concat(upper(x[1]), x[2:])), ' ') AS title FROM part")
def c3_merchant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" -* "), F.regexp_replace("p_name", " ", "  "), F.lit(" (x) *"))
    return table(spark, sf_dir, "part").select("p_partkey", C.clean_merchant(raw).alias("clean"), C.merchant_key(F.concat("p_name", F.lit(".com"))).alias("key"), C.title_case(F.col("p_name")).alias("title"))


@query("SELECT c_custkey, right(lpad(cast(c_custkey AS varchar), 6, '0'), 4) AS contiguous, right(lpad(cast(c_custkey AS varchar), 6, '0'), 4) AS digits, '' AS none FROM customer")
def c4_account_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("XX"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("."))
    return table(spark, sf_dir, "customer").select("c_custkey", C.last4_contiguous(shown).alias("contiguous"), C.last4_digits(shown).alias("digits"), C.last4_or_empty(F.lit("XX")).alias("none"))


@query("SELECT p_partkey, array_to_string(string_split(lower(p_type), ' '), '|') AS parts FROM part")
def c9_split_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.split_merchant(F.regexp_replace("p_type", " ", " - ")), "|").alias("parts"))


@query("WITH t AS (SELECT DISTINCT unnest(string_split(concat(lower(p_name), ' ', lower(p_type)), ' ')) AS w FROM part) SELECT a.w AS a, b.w AS b, round(jaro_winkler_similarity(a.w, b.w), 6) AS score FROM t a JOIN t b ON a.w[1] = b.w[1] AND abs(length(a.w) - length(b.w)) <= 3 WHERE a.w < b.w")
def c11_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of part names and types that begin alike and are about as long."""
    p = table(spark, sf_dir, "part").select(F.explode(C.split_merchant(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).distinct()
    a, b = p.select(F.col("w").alias("a"), F.substring("w", 1, 1).alias("k")), p.select(F.col("w").alias("b"), F.substring("w", 1, 1).alias("k"))
    pairs = a.join(b, "k").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 3))
    return pairs.select("a", "b", F.round(C.jaro_winkler_col("a", "b"), 6).alias("score"))


_TOKENS = "t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), k AS (SELECT keyword, row_number() OVER (ORDER BY keyword) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS keyword FROM benchmark))"


def _letters(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return C.distinct_found(table(spark, sf_dir, name), F.lower("text"), "[a-z]+", column)


@query()
def c11_similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of words of documents and of the benchmark, short ones too, with a similarity over 0.9, by the index. SQL engines round transpositions down, so a test holds this against all pairs."""
    pairs = C.similar_candidates(_letters(spark, sf_dir, "documents", "a"), _letters(spark, sf_dir, "benchmark", "b"))
    return pairs.withColumn("score", C.jaro_winkler_col("a", "b")).where("score > 0.9")


@query(f"WITH {_TOKENS}, s AS (SELECT token FROM t WHERE length(token) <= 4), i AS (SELECT token, keyword FROM s, k WHERE length(keyword) > 3 AND contains(token, keyword)), p AS (SELECT token, unnest([1, 2, 3, 4]) AS len FROM s), q AS (SELECT DISTINCT token, len, token[i:i + len - 1] AS piece FROM (SELECT token, len, unnest(range(1, length(token) - len + 2)) AS i FROM p WHERE len <= length(token))), l AS (SELECT token, keyword, row_number() OVER (PARTITION BY token ORDER BY len DESC, ord DESC) AS o, len FROM q JOIN k ON contains(keyword, piece)) SELECT token, keyword FROM i UNION SELECT token, keyword FROM l WHERE o = 1 AND len >= length(keyword) - CASE WHEN length(keyword) > 4 THEN 1 ELSE 0 END")
def j11_short_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the short words of documents mean, with the words of the benchmark as keywords, of which the last by the alphabet wins."""
    keys = _letters(spark, sf_dir, "benchmark", "keyword").withColumn("ord", F.col("keyword"))
    return brands.token_matches(_letters(spark, sf_dir, "documents", "token").where(F.length("token") <= 4), keys)


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'out' WHEN 'signup' THEN 'in' ELSE 'none' END AS flow FROM events")
def c12_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "EXPENSE").when(F.col("event_type") == "signup", "SALARY").otherwise("WALLET_CREDIT")
    return table(spark, sf_dir, "events").select("event_id", C.direction_of(kind).alias("flow"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), b AS (SELECT doc_id, i, w[i] AS x, w[i+1] AS y, w[i-1] AS z FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)) SELECT doc_id, cast(i - 1 AS integer) AS pos, CASE WHEN x = 'of' AND y = 'the' THEN 'PAIR' WHEN x = 'of' THEN 'OF' ELSE 'THE' END AS type FROM b WHERE x = 'of' OR (x = 'the' AND coalesce(z, '') <> 'of')")
def t1_tag_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, "phrase string, type string, norm string", ("of", "OF", "of"), ("the", "THE", "the"), ("of the", "PAIR", "of the"))
    return corpus.tag_keywords(table(spark, sf_dir, "documents"), d, 2, "doc_id").select("doc_id", "pos", "type")


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), b AS (SELECT doc_id, i, w[i] AS x, w[i-1] AS z FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)) SELECT doc_id, cast(i - 1 AS integer) AS pos, CASE x WHEN 'of' THEN 'OF' ELSE 'THE' END AS type FROM b WHERE x = 'of' OR (x = 'the' AND coalesce(z, '') <> 'of')")
def t2_merge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    the = corpus.tag_keywords(d, rows(spark, "phrase string, type string, norm string", ("the", "THE", "the")), 1, "doc_id")
    of = corpus.tag_keywords(d, rows(spark, "phrase string, type string, norm string", ("of", "OF", "of")), 1, "doc_id")
    wide = of.withColumn("end", F.col("end") + 1)  # covers the word after it
    return corpus.merge_spans(wide, the, "doc_id").select("doc_id", "pos", "type")


#: Where "debited" is among the words of each shape.
_DEBITED = case({**{k: "3" for k in (0, 6, 9, 17, 18, 28)}, 19: "7", 26: "5"})


@query(rich_sql(spans=case({**{k: "1" for k in (4, 21, 23, 24, 25, 27, 29, 31)}, **{k: "2" for k in (2, 3, 5, 6, 8, 9, 10, 15, 16, 17, 19, 20, 26)}, 14: "2", **{k: "3" for k in (1, 7, 11, 13, 18, 22, 28, 30)}, 0: "5"}, "0"), verbs=f"CASE WHEN {_DEBITED} IS NULL THEN 0 ELSE 1 END", verb_at=_DEBITED, plans=case({2: "1"}, "0"), hidden="0", first_word=case({**{k: "0" for k in (0, 1, 3, 4, 6, 7, 8, 9, 16, 21, 22, 26, 29)}, 2: "6", 5: "2", 10: "3", 11: "8", 13: "2", 14: "5", 15: "2", 16: "2", 17: "2", 18: "2", 19: "2", 20: "3", 23: "5", 24: "3", 25: "3", 27: "2", 28: "2", 30: "2", 31: "6"})))
def t2_merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed spans of the rich messages and tagged phrases: those within an amount, a data size or a date give way, others stay."""
    m = X.rich(spark, sf_dir)
    d = rows(spark, "phrase string, type string, norm string", ("debited", "VERB", "debit"), ("data plan", "PLAN", "plan"), ("gb data", "HIDDEN", "data"), ("rs", "HIDDEN", "rs"), ("inr", "HIDDEN", "inr"), ("gb", "HIDDEN", "gb"))
    typed = corpus.typed_spans(m, "msg_id", "body").select("msg_id", F.col("word").alias("pos"), F.col("word_end").alias("end"), F.col("kind").alias("type"), F.col("raw").alias("norm"))
    merged = corpus.merge_spans(typed, corpus.tag_keywords(m, d, key="msg_id", text="body"), "msg_id")
    n = lambda hit: F.count_if(hit).cast("int")
    is_tag = F.col("type").isin("VERB", "PLAN", "HIDDEN")
    found = merged.groupBy("msg_id").agg(n(~is_tag).alias("spans"), n(F.col("type") == "VERB").alias("verbs"), F.min(F.when(F.col("type") == "VERB", F.col("pos"))).alias("verb_at"), n(F.col("type") == "PLAN").alias("plans"), n(F.col("type") == "HIDDEN").alias("hidden"), F.min(F.when(~is_tag, F.col("pos"))).alias("first_word"))
    return m.select("msg_id").join(found, "msg_id", "left").na.fill(0, ["spans", "verbs", "plans", "hidden"])


_RULES = [(1, "OF", "THE", 0, ()), (2, "THE", "AND", 3, ("THE", "AND")), (3, "AND", "OF", 9, ("THE",))]


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), b AS (SELECT doc_id, i - 1 AS p, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)), m AS (SELECT * FROM b WHERE x IN ('of', 'the', 'and')),
q AS (SELECT a.doc_id, CASE a.x WHEN 'of' THEN 1 WHEN 'the' THEN 2 ELSE 3 END AS rule, a.p AS a_pos, c.p AS b_pos FROM m a JOIN m c ON a.doc_id = c.doc_id AND c.p > a.p AND (a.x = 'of' AND c.x = 'the' AND c.p - a.p <= 1 OR a.x = 'the' AND c.x = 'and' AND c.p - a.p <= 4 OR a.x = 'and' AND c.x = 'of' AND c.p - a.p <= 10)
 WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = a.doc_id AND o.p > a.p AND o.p < c.p AND (a.x = 'the' AND o.x = 'of' OR a.x = 'and' AND o.x <> 'the')))
SELECT doc_id, rule, cast(a_pos AS integer) AS a_pos, cast(b_pos AS integer) AS b_pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, b_pos - a_pos, a_pos) AS k FROM q) WHERE k = 1""")
def t3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules, of which the first that holds in a text wins."""
    spans = corpus.tokens(table(spark, sf_dir, "documents"), "doc_id").where(F.col("word").isin("the", "and", "of")).select("doc_id", "pos", F.upper("word").alias("type"))
    return corpus.near(spans, _RULES, "doc_id").select("doc_id", "rule", "a_pos", "b_pos")


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), b AS (SELECT doc_id, i - 1 AS p, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)), s AS (SELECT a.doc_id, a.p, min(c.p) AS stop FROM b a LEFT JOIN b c ON a.doc_id = c.doc_id AND c.p > a.p AND c.x = 'and' WHERE a.x = 'the' GROUP BY ALL), f AS (SELECT doc_id, arg_min(stop, p) AS stop, min(p) AS start FROM (SELECT doc_id, p, coalesce(stop, 2147483647) AS stop FROM s WHERE coalesce(stop, 2147483647) > p + 1) GROUP BY doc_id) SELECT f.doc_id, cast(start AS integer) AS start, string_agg(b.x, ' ' ORDER BY b.p) AS captured FROM f JOIN b ON b.doc_id = f.doc_id AND b.p > f.start AND b.p < f.stop WHERE NOT regexp_matches(b.x, '^[0-9]+$') GROUP BY ALL")
def t4_capture_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.capture_between(corpus.tokens(table(spark, sf_dir, "documents"), "doc_id"), ["the"], ["and"], "doc_id")


_SPANS = {
    "amounts": case({2: "0", 10: "0", 12: "0", 0: "2", 13: "2", 16: "2", 22: "2", 30: "2"}, "1"), "accounts": case({**{k: "1" for k in (0, 1, 3, 6, 7, 8, 9, 17, 20, 26, 28)}, 18: "2"}, "0"), "percents": case({14: "1"}, "0"), "sizes": case({2: "1", 15: "1"}, "0"),
    "dates": case({k: "1" for k in (0, 1, 2, 7, 13, 19)}, "0"), "times": case({11: "2", 30: "1"}, "0"), "phones": case({5: "1", 28: "1"}, "0"),
    "total": case({2: "0", 10: "0", 12: "0", 20: BALANCE, **{k: f"cast(cast(o_totalprice AS decimal(18,2)) + cast(o_totalprice*2 AS decimal(18,2)) AS double)" for k in (0, 13, 16, 22, 30)}}, AMOUNT),
    "first_span": case({2: "'1.5 GB'", 15: "'250 MB'", 14: "'20%'"}), "percent": case({14: "20.0"}),
}


@query(rich_sql(**_SPANS))
def x28_typed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.rich(spark, sf_dir)
    n = lambda k: F.count_if(F.col("kind") == k).cast("int")
    value = lambda k: F.when(F.col("kind") == k, F.col("value"))
    found = corpus.typed_spans(m, "msg_id", "body").groupBy("msg_id").agg(
        *[n(k).alias(v) for k, v in (("amount", "amounts"), ("account", "accounts"), ("percent", "percents"), ("data_size", "sizes"), ("date", "dates"), ("time", "times"), ("phone", "phones"))],
        F.sum(value("amount")).cast("double").alias("total"), F.max(F.when(F.col("kind").isin("data_size", "percent"), F.col("raw"))).alias("first_span"), F.max(value("percent")).cast("double").alias("percent"),
    )
    return m.select("msg_id").join(found, "msg_id", "left").na.fill(0, ["amounts", "accounts", "percents", "sizes", "dates", "times", "phones", "total"])


_BODY = X.sql("CASE o_orderkey % 32 " + " ".join(f"WHEN {i} THEN {X.expand(t, 'varchar')}" for i, t in enumerate(X.RICH)) + " END")
_MORE = " Extra Rs.2.5 lakh or INR 7k."
#: Spans of the shapes: (shapes, kind, what stands right before, text, value).
_PLACES = (
    ((0, 3, 4, 5, 6, 7, 8, 9, 11, 13, 14, 15, 16, 17, 18, 19, 21, 22, 23, 24, 25, 26, 28, 29, 30, 31), "amount", "''", "concat('Rs.', {AMT})", AMOUNT), ((1,), "amount", "''", "concat('INR ', {AMT})", AMOUNT), ((27,), "amount", "''", "concat('€', {AMT})", AMOUNT),
    ((0, 13, 16, 20, 22, 30), "amount", "''", "concat('Rs.', {BAL})", BALANCE), ((0, 1, 3, 6, 7, 8, 9, 17, 18, 20, 26, 28), "account", "''", "concat('XX', {TAIL})", "NULL"), ((18,), "account", "''", "concat('XX', {OTHER})", "NULL"),
    ((0, 1, 2, 7, 13, 19), "date", "''", "{DAY}", "NULL"), ((0,), "number", "'Ref '", "{REF}", "cast(o_orderkey AS double)"), ((2,), "data_size", "''", "'1.5 GB'", "NULL"), ((15,), "data_size", "''", "'250 MB'", "NULL"), ((5, 28), "phone", "''", "{PHONE}", "NULL"),
    ((10,), "number", "'OTP is '", "{SIX}", "cast(o_orderkey % 1000000 AS double)"), ((10,), "number", "'for '", "'10'", "10.0"), ((11,), "time", "''", "'10:30'", "NULL"), ((11,), "time", "''", "'12:45'", "NULL"), ((30,), "time", "''", "'10:45'", "NULL"), ((14,), "percent", "''", "'20%'", "20.0"), ((22,), "number", "'ending '", "{TAIL}", "cast(o_custkey % 10000 AS double)"),
    (range(32), "amount", "'Extra '", "'Rs.2.5 lakh'", "250000.0"), (range(32), "amount", "'or '", "'INR 7k'", "7000.0"),
)


@query("SELECT msg_id, kind, raw, cast(strpos(body, concat(lead, raw)) - 1 + length(lead) AS integer) AS pos, cast(strpos(body, concat(lead, raw)) - 1 + length(lead) + length(raw) AS integer) AS \"end\", cast(value AS double) AS value FROM (" + " UNION ALL ".join(f"SELECT {ID} AS msg_id, concat({_BODY}, '{_MORE}') AS body, '{kind}' AS kind, {X.sql(lead)} AS lead, {X.sql(raw)} AS raw, {value} AS value FROM orders WHERE o_orderkey % 32 IN ({', '.join(map(str, k))})" for k, kind, lead, raw, value in _PLACES) + ")")
def x28_span_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of the rich messages, with multiples of amounts, by its place."""
    m = X.rich(spark, sf_dir).select("msg_id", F.concat("body", F.lit(_MORE)).alias("body"))
    return corpus.typed_spans(m, "msg_id", "body").select("msg_id", "kind", "raw", "pos", "end", num("value"))


@query(f"SELECT {ID} AS msg_id, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day_first, strftime(o_orderdate, '%Y-%m-%d') AS named, strftime(o_orderdate, '%Y-%m-%d') AS two_digits, strftime(o_orderdate, '%Y-%m-%d') AS no_year, CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') END AS swapped, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS junk FROM orders")
def x29_normal_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.messages(spark, sf_dir)
    form = lambda f: corpus.normal_date(F.date_format("ts", f), F.col("ts")).cast("string")
    return m.select("msg_id", form("yyyy-MM-dd").alias("iso"), form("dd/MM/yyyy").alias("day_first"), form("dd-MMM-yyyy").alias("named"), form("dd-MM-yy").alias("two_digits"), form("dd MMM").alias("no_year"), form("MM-dd-yyyy").alias("swapped"), corpus.normal_date(F.concat(F.when(F.substring("msg_id", 2, 20).cast("long") % 2 == 0, "").otherwise("1"), F.date_format("ts", "dd/MM/yyyy")), F.col("ts")).cast("string").alias("junk"))


@query(rich_sql(amount=case({k: AMOUNT for k in (0, 1, 4, 6, 7, 9, 14, 16, 17, 18, 19, 21, 22, 26, 27, 28, 29, 30)}), balance=case({0: BALANCE, 15: AMOUNT, 20: f"-({BALANCE})", 30: BALANCE})))
def x32_fallback_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.rich(spark, sf_dir)
    return corpus.fallback_amount(corpus.typed_spans(m, "msg_id", "body"), m).select("msg_id", num("amount"), num("balance"))


@query("SELECT doc_id, sha256(array_to_string(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: concat(w[i], ' ', w[i + 1]))), '|')) AS grams FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)")
def c7_word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", C.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.sha2(F.array_join(C.word_ngrams(F.col("w"), 2), "|"), 256).alias("grams"))


@query(rich_sql(masked=f"regexp_replace({X.sql('CASE o_orderkey % 32 ' + ' '.join(f'WHEN {i} THEN {X.expand(t, chr(123) + chr(83) + chr(125)).replace(chr(123) + chr(83) + chr(125), chr(118) + chr(97) + chr(114) + chr(99) + chr(104) + chr(97) + chr(114))}' for i, t in enumerate(X.RICH)) + ' END')}, '(?i)(?:\\b(?:rs|inr|usd)\\.?\\s*|[₹$€£])?\\b\\d[\\d,]*(?:\\.\\d+)?\\b', 'AMT', 'g')"))
def c8_mask_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rich(spark, sf_dir).select("msg_id", C.mask_amounts(F.col("body")).alias("masked"))


@query(_TX + f", f AS (SELECT DISTINCT user_id, currency FROM tx WHERE c % 50 % 5 < 2 AND k = 2 OR c % 50 % 5 = 2), u AS (SELECT DISTINCT {WHO} AS user_id FROM orders) SELECT user_id, coalesce(currency, 'INR') AS currency FROM u LEFT JOIN f USING (user_id)")
def u1_distinct_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of whom some have transactions in one currency, some in two and some in none."""
    group = F.pmod(F.substring("user_id", 2, 9).cast("long"), F.lit(5))
    tx = transactions(spark, sf_dir).where(((group < 2) & (F.col("currency") == "USD")) | (group == 2))
    quiet = X.messages(spark, sf_dir).select("user_id").distinct().select("user_id", F.lit("INR").alias("currency"), F.lit(0).alias("income"), F.lit(0).alias("expense"))
    return ledger.currencies(ledger.monthly_totals(tx, "type").select("user_id", "currency", "income", "expense").union(quiet)).select("user_id", "currency")


@query(f"SELECT {ID} AS msg_id FROM orders WHERE o_orderkey % 32 IN (0, 1, 4, 6, 7, 9, 14, 16, 17, 18, 19, 21, 22, 26, 27, 28, 29, 30)")
def f5_extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shapes, without the gate of words before: some have an amount and no type, some neither."""
    m = X.rich(spark, sf_dir)
    return gates.has_amount_and_type(m.select("msg_id", fields.amount(F.col("body")).alias("amount"), fields.direction(F.col("body")).alias("type"))).select("msg_id")


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'click') AND value IS NOT NULL AND event_id % 3 <> 0 AND user_id % 7 <> 0")
def f13_recurrence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", "EXPENSE").when(F.col("event_type") == "click", "WALLET_DEBIT").otherwise("INCOME").alias("rich_type"), F.when(F.col("event_id") % 3 == 0, "m@abc").alias("mandate_id"), F.when(F.col("user_id") % 7 != 0, F.col("event_type")).alias("merchant"), F.col("value").alias("amount"))
    return gates.recurrence_candidates(e).select("event_id")


@query(rich_sql(x="1") + " WHERE o_orderkey % 32 IN (0,1,3,4,5,6,7,8,9,14,17,18,19,20,21,22,26,27,28,29,30)")
def f12_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.rich(spark, sf_dir).select("msg_id", fields.rich_type(F.col("body")).alias("rich_type"), fields.amount(F.col("body")).alias("amount"))
    return gates.recognised(m).select("msg_id", F.lit(1).alias("x"))


@query("SELECT conv_id, turn, sha256(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS digest FROM conversations")
def x04_cleanup_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(C.collapse(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))), 256).alias("digest"))


@query("SELECT p_partkey, p_name AS merchant FROM part")
def x04_merchant_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("- "), F.col("p_name"), F.lit(" PVT LTD Ref 123 (ok)"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.cleanup(raw).alias("merchant"))


@query(_TX + _TX_ROWS)
def s4_stream_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream of the messages, late ones and repeated ones among them, run to its end; the target table's rows."""
    from ..streaming import ingest

    folder = X.shared_path(spark, "stream")
    m = X.messages(spark, sf_dir).withColumn("late", F.pmod(F.xxhash64("msg_id"), F.lit(2)))
    for late in (0, 1, 0):  # files come in the order of a hash, so times go back and forth; half of them come twice
        m.where(F.col("late") == late).drop("late").write.mode("append").parquet(f"{folder}/in")
        run = ingest.stream_transactions(ingest.message_stream(spark, f"{folder}/in"), routing.institutions(spark), f"{folder}/out", f"{folder}/state", f"{folder}/rejects", trigger={"availableNow": True})
        run.awaitTermination()
    return _tx_rows(spark.read.parquet(f"{folder}/out"))


_WIDE = {"rich_type": case({1: "'SALARY'", 3: "'WALLET_CREDIT'", 4: "'WALLET_DEBIT'", 5: "'RECHARGE'", 6: "'AUTO_DEBIT'", 7: "'ATM_WITHDRAWAL'", 8: "'TRANSFER'", 9: "'INVESTMENT'", 20: "'BALANCE_UPDATE'", 29: "'INCOME'", 30: "'INCOME'", **{k: "'EXPENSE'" for k in (0, 17, 18, 19, 21, 22, 26, 27, 28)}})}


@query(rich_sql(**_WIDE, category=case({10: "'OTP'", 11: "'TRAVEL'", 25: "'OFFERS'", 14: "'OFFERS'"}, "CASE o_custkey % 3 WHEN 1 THEN 'BILL' ELSE 'BANK' END"), tags=case({10: "'OTP'", 11: "'TRAVEL'", 14: "'OFFERS'", 25: "'OFFERS'"}), brand=case({k: "CASE WHEN o_custkey % 37 = 3 THEN 'Shop Three' END" for k in (0, 4, 24)}), payee=case({0: "CASE WHEN o_custkey % 37 = 3 THEN 'Shop Three' ELSE {SHOP} END", 4: "CASE WHEN o_custkey % 37 = 3 THEN 'Shop Three' ELSE {SHOP} END", 24: "CASE WHEN o_custkey % 37 = 3 THEN 'Shop Three' ELSE {BANK} END", 6: "{SERVICE}", 8: "{PAYER}", 17: "{PAYER}", 21: "'Green Grocer'", 22: "{STORE}", 27: "{STORE}", 28: "{PAYER}", 29: "{PAYER}"}, "{BANK}").replace("{BANK}", "CASE o_custkey % 3 WHEN 0 THEN 'Alpha Bank' WHEN 1 THEN 'Beta Bank' ELSE 'Gamma Card' END"), origin=case({11: "'DEL'"}), otp_code=case({10: "{SIX}"}), folio=case({k: "concat('F', {SIX})" for k in (9, 16)}), bill_amount=case({13: "{AMT}"})))
def x37_wide_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of every message, with all dictionaries; some of its columns."""
    words = rows(spark, "phrase string, type string, norm string", ("otp", "OTP", "otp"), ("flight", "TRAVEL", "flight"), ("offer", "OFFERS", "offer"))
    senders = rows(spark, "alias string, category string", ("BETABK", "BILL"))
    known = rows(spark, "token string, brand string, category string, online boolean, ord int", ("shop30", None, None, False, 1), *[(f"shop{i}", None, None, False, 1) for i in range(31, 37)], ("shop3", "Shop Three", "A", True, 2))
    banks = (rows(spark, "alias string, bank string, prio int", ("ALPHBK", "Alpha Bank", 1)), rows(spark, "alias string, raw string, prio int", *_ALIASES[:2]), rows(spark, "name string", *_KNOWN))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    spam = (classify.train(docs, labels, "quality"), classify.priors(labels, "quality"))
    places = rows(spark, "word string, code string", ("delhi", "DEL"), ("mumbai", "BOM"))
    out = extract.wide(X.rich(spark, sf_dir), routing.institutions(spark), words, senders, known, banks, spam, places).where("spam_class IS NOT NULL")
    return out.select("msg_id", "rich_type", "category", F.array_join(F.map_keys("tags"), ",").alias("tags"), "brand", "payee", "origin", "otp_code", "folio", "bill_amount")
