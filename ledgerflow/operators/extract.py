"""Message tables to transaction, balance and mandate tables: one projection after the cheap filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as C
from ..functions.small import small, stored
from ..functions.text import direction_of
from . import brands, classify, corpus, fields, gates, routing

#: Own rules of institutions, tried before the general ones, in the order of prio. A rule of "gate" says whether a body that
#: its pattern matches is a transaction ("accept" or "reject"), one of "type" or "is_card" what it is; others capture a field.
RULE = "institution string, field string, prio int, pattern string, value string"
OWN = [
    ("Beta Bank", "merchant", 1, r"(?i)\bInfo:\s*([^.;]{2,60})", None),
    ("Beta Bank", "reference", 1, r"(?i)\bSeq\s*#\s*(\d{6,20})\b", None),
    ("Gamma Card", "merchant", 1, r"(?i)\bmerchant\s+([^.;]{2,60}?)(?=\s+on\b|[.;]|$)", None),
]
#: What a captured text must be, by field.
_USABLE: dict[str, Callable[[Column], Column] | None] = {
    "amount": lambda v: C.parse_amount(v), "balance": lambda v: C.parse_amount(v, positive=False), "credit_limit": lambda v: C.parse_amount(v, positive=False),
    "account_last4": lambda v: F.right(F.regexp_replace(v, r"\D", ""), F.lit(4)), "merchant": fields.valid_merchant, "reference": None, "currency": F.upper,
}
_SAYS = ("gate", "type", "is_card")


def own_rules(table: DataFrame | None, spark: SparkSession | None = None) -> list[Row]:
    """The rows of a rule table (``RULE``), a dictionary of a few rows an institution, in order; ``OWN`` without one."""
    table = (spark or table.sparkSession).createDataFrame(OWN, RULE) if table is None else table
    rows = table.select("institution", "field", "prio", "pattern", "value").orderBy("institution", "field", "prio", "pattern").collect()
    if wrong := {r.field for r in rows} - {*_USABLE, *_SAYS}:
        raise ValueError(f"rules of unknown fields: {sorted(wrong)}")
    return rows


def scoped(field: str, body: Column, institution: Column, general: Column, own: list[Row]) -> Column:
    """What the institution's own rules say of ``field``, else the general rule."""
    out = None
    for name in sorted({r.institution for r in own if r.field == field}):
        rules = [r for r in own if r.field == field and r.institution == name]
        if field in _SAYS:
            found = F.coalesce(*[F.when(body.rlike(r.pattern), r.value) for r in rules])
            found = found if field == "type" else found.isin("accept", "true")
        else:
            found = fields.first(body, tuple(r.pattern for r in rules), _USABLE[field])
        own_first = F.coalesce(found, general)
        out = F.when(institution == name, own_first) if out is None else out.when(institution == name, own_first)
    return general if out is None else out.otherwise(general)


def extract_transactions(messages: DataFrame, rules: DataFrame, gate: bool = True, own: DataFrame | None = None) -> DataFrame:
    """A row a message that states a transaction, in the TRANSACTION schema.

    Length guard and gate are filters before the extraction, so that rejected bodies see no field pattern. Senders are
    routed first: their distinct values come from a scan of that column alone, and the filters go below the join.
    ``own`` is a table of rules of institutions (``RULE``), which go before the general ones.
    """
    body, who, low = F.col("body"), F.col("institution"), F.col("_low")
    own_ = own_rules(own, messages.sparkSession)
    rows = routing.route_sender(messages, rules).where(gates.short_enough(body))
    # an outer explode has no filter that goes below it, so each text is lower-cased once
    rows = rows.select("user_id", "msg_id", "sender", "body", "ts", "institution", "type_override", "kind", F.explode_outer(F.array(F.lower(body))).alias("_low"))
    rows = rows.where(scoped("gate", body, who, gates.is_transaction(body, lower=low), own_)) if gate else rows

    def of(field: str, general: Column) -> Column:
        return scoped(field, body, who, general, own_).alias(field)

    way = C.let(fields.direction(body, low), lambda d: F.when(d.isNotNull() | gates.is_card(body, low), F.coalesce("type_override", d)))
    # so are amount and type found once, and the other fields only of rows that have both
    rows = gates.has_amount_and_type(rows.select("*", F.inline_outer(F.array(F.struct(of("amount", fields.amount(body, low)), of("type", way))))))
    found = rows.select(
        "user_id", "msg_id", "sender", "body", "ts", "institution", "amount", "type",
        fields.negated(body, low).alias("negated"),
        of("currency", fields.currency(body, low)),
        of("merchant", fields.merchant(body, lower=low)),
        of("reference", fields.reference(body, low)),
        of("account_last4", fields.account_tail(body, low)),
        of("balance", fields.balance(body, low)),
        of("credit_limit", fields.credit_limit(body, low)),
        of("is_card", gates.is_card(body, low) | (F.col("kind") == "card")),
        fields.other_account(body, low).alias("other_account"),
    )
    out = F.when(F.col("type") == "CREDIT", F.col("credit_limit"))
    first_is_from = F.col("type").isin("EXPENSE", "TRANSFER", "CREDIT", "INVESTMENT")
    return found.select(
        "user_id", "msg_id", "sender", "body", "ts", "institution", "amount", "type", F.when(F.col("negated"), "none").otherwise(direction_of(F.col("type"))).alias("flow"), "negated", "currency", "merchant", "reference", "account_last4", "balance", out.alias("credit_limit"), F.coalesce("is_card", F.lit(False)).alias("is_card"),
        F.when(first_is_from, F.col("account_last4")).otherwise(F.col("other_account")).alias("from_account"), F.when(first_is_from, F.col("other_account")).otherwise(F.col("account_last4")).alias("to_account"),
        fields.txn_id(F.col("sender"), F.col("amount"), F.col("body")).alias("txn_id"),
    )


def balance_notices(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """(user_id, msg_id, ts, institution, account_last4, balance, as_of, is_credit_card) of notices that state no transaction."""
    body = F.col("body")
    rows = routing.route_sender(messages, rules).where(gates.short_enough(body) & gates.is_balance_notice(body))
    as_of, _ = fields.dated(body)
    return rows.select("user_id", "msg_id", "ts", "institution", fields.account_tail(body).alias("account_last4"), fields.balance(body).alias("balance"), as_of.alias("as_of"), gates.is_card(body).alias("is_credit_card")).where("balance IS NOT NULL")


def upcoming_mandates(messages: DataFrame) -> DataFrame:
    """(user_id, msg_id, ts, amount, next_date, date_format, merchant, mandate_no) of debits that are to come."""
    body = F.col("body")
    date, form = fields.dated(body)
    rows = messages.where(gates.mandate_notice(body).isin("upcoming", "future_debit"))
    number = F.nullif(F.regexp_extract(body, r"(?i)\b(?:mandate|SI)\s*(?:no\.?|id|number)\s*[:#]?\s*([A-Z0-9]{4,20})\b", 1), F.lit(""))
    towards = F.nullif(F.regexp_extract(body, r"(?i)\btowards\s+(.{1,60}?)(?=\s+(?:for|on)\b|[.;]|$)", 1), F.lit(""))
    return rows.select("user_id", "msg_id", "ts", fields.amount(body).alias("amount"), date.alias("next_date"), form.alias("date_format"), F.coalesce(fields.valid_merchant(towards), F.lit("Unknown Subscription")).alias("merchant"), number.alias("mandate_no"))


def mandate_events(messages: DataFrame) -> DataFrame:
    """(user_id, msg_id, sender, ts, mandate_id, status, merchant, amount) of messages with a mandate id."""
    body = F.col("body")
    rows = messages.select("user_id", "msg_id", "sender", "ts", fields.mandate_id(body).alias("mandate_id"), fields.mandate_event(body).alias("status"), fields.mandate_merchant(body).alias("merchant"), fields.mandate_amount(body).alias("amount"))
    return rows.where("mandate_id IS NOT NULL")


def _facts(body: Column, low: Column, investment: Column) -> list[Column]:
    """Rich type, subcategory, amount, balance, payee and mandate fields of a body."""
    mandate = fields.mandate_id(body, low)
    return [
        F.when(gates.stated_reason(body, lower=low).isin("otp", "promo", "request", "due", "received_notice"), None).when(mandate.isNotNull(), None).otherwise(fields.rich_type(body, low, investment)).alias("rich_type"),
        fields.subcategory(body, low).alias("subcategory"), fields.amount(body, low).alias("amount"), fields.currency(body, low).alias("currency"), fields.merchant(body, lower=low).alias("merchant"), fields.account_tail(body, low).alias("account_last4"), fields.balance(body, low).alias("balance"),
        mandate.alias("mandate_id"), fields.mandate_event(body, low).alias("mandate_event"), fields.mandate_merchant(body, low).alias("mandate_merchant"), fields.mandate_amount(body, low).alias("mandate_amount"),
    ]


def _lowered(messages: DataFrame) -> DataFrame:
    """Messages that are short enough, with the lower-case text as _low and as _invest whether it is an investment's, which are found once: nothing goes below an outer explode."""
    rows = corpus.lowered(messages.where(gates.short_enough(F.col("body"))), "body")
    return rows.select("*", F.explode_outer(F.array(gates.is_investment(F.col("body"), lower=F.col("_low")))).alias("_invest"))


def enriched(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """The dashboard's view of every message: rich type, subcategory, amount, balance, payee, mandate fields."""
    rows = _lowered(routing.route_sender(messages, rules))
    return rows.select("user_id", "msg_id", "sender", "ts", F.col("institution").alias("bank_name"), *_facts(F.col("body"), F.col("_low"), F.col("_invest")))


def travel_places(messages: DataFrame, places: DataFrame, key: str = "msg_id", body: str = "body") -> DataFrame:
    """(key, origin, destination): codes of the first two places (word, code) that a travel message names."""
    trips = corpus.lowered(messages, body).where(fields.of_family(F.col("_low"), "travel"))
    return routing.place_codes(trips, places, key, body).select(key, F.get("codes", F.lit(0)).alias("origin"), F.get("codes", F.lit(1)).alias("destination"))


def wide(
    messages: DataFrame, rules: DataFrame, words: DataFrame | None = None, senders: DataFrame | None = None, known_brands: DataFrame | None = None,
    banks: tuple[DataFrame, DataFrame, DataFrame] | None = None, spam: tuple[DataFrame, DataFrame] | None = None, places: DataFrame | None = None,
) -> DataFrame:
    """All that is known of every message, a row each: ``enriched``, the fields of all families, narration and payees, keys.

    Dictionaries add to it: ``words`` (phrase, type, norm) the tags (a map of type to norms) and the category, for which
    ``senders`` (alias, category) is the fallback; ``known_brands`` brand, brand_category and online; ``banks`` (exact names,
    aliases, known names) the bank's name; ``spam`` (model and priors of a classifier) a score and class; ``places`` origin
    and destination. What depends on the sender alone is found on the different senders, which are written when this is called
    and broadcast where they are few; all else of a text is one projection. What other dictionaries say is joined by message, so rows are shuffled once.
    """
    body, low = F.col("body"), F.col("_low")
    # the different senders and what is known of each
    by_sender = routing.route_sender(stored(routing.distinct_senders(messages), "senders"), rules).select("sender", "institution")
    if words is not None:
        by_sender = by_sender.withColumn("sender_category", F.lit(None).cast("string")) if senders is None else routing.sender_category(by_sender, senders)
    if banks is not None:
        by_sender = routing.bank_of_sender(by_sender, *banks)
    rows = _lowered(messages).join(small(stored(by_sender, "sender-facts")), "sender", "left")

    facts = [F.col("user_id"), F.col("msg_id"), F.col("sender"), F.col("ts"), F.col("body"), *_facts(body, low, F.col("_invest"))]
    facts[-1] = fields.mandate_amount(body, low).alias("mandate_event_amount")
    families = [c.alias(k) for family in fields.PACKS for k, c in fields.pack(body, family, low).items()]
    said, two, address = fields.narration(body, low), fields.two_accounts(body, low), fields.address_of(body)
    more = [
        said["channel"].alias("channel"), said["reference"].alias("narration_reference"), said["counterparty"].alias("counterparty"), two["other"].alias("other_account"),
        address.alias("address"), fields.payee_alias(address).alias("vendor"), fields.channel_label(body, low).alias("channel_label"), fields.reference(body, low).alias("reference"), fields.credit_limit(body, low).alias("credit_limit"),
        fields.negated(body, low).alias("negated"), fields.txn_id(F.col("sender"), fields.amount(body, low), body).alias("txn_id"), fields.event_key(body, F.col("sender"), F.col("ts")).alias("event_key"),
    ]
    brand = bank = F.lit(None).cast("string")
    if banks is None:
        names = [F.col("institution").alias("bank_name")]
    else:
        pattern = routing.bank_by_pattern(body, F.col("sender"), low)
        names, bank = [F.col("institution"), F.col("bank_exact"), F.col("bank_alias"), pattern.alias("bank_pattern"), F.coalesce("bank_exact", "bank_alias", pattern, "institution").alias("bank_name")], F.col("bank_name")
    out = rows.select(*facts, *families, *more, *names, *(["sender_category"] if words is not None else []))
    if known_brands is not None:
        out, brand = brands.brand_of(out, known_brands), F.col("brand")
    # joins by message from here on, which share one shuffle
    if words is not None:
        tags = corpus.tag_keywords(corpus.with_a_word(messages, words, "body"), words, None, "msg_id", "body")
        norms = tags.groupBy("msg_id", "type").agg(F.array_sort(F.collect_set("norm")).alias("norms")).groupBy("msg_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "norms")))).alias("tags"))
        out = out.join(norms, "msg_id", "left").withColumn("category", routing.category_of(F.col("tags"), F.col("sender_category")))
    if places is not None:
        out = out.join(travel_places(messages, places), "msg_id", "left")
    if spam is not None:
        scored = classify.score(messages, *spam, key="msg_id", text="body").withColumnsRenamed({"score": "spam_score", "class": "spam_class"})
        out = out.join(scored, "msg_id", "left")
    return out.withColumn("payee", fields.display_payee(brand, F.coalesce("merchant", "vendor", "counterparty"), bank, F.col("sender")))
