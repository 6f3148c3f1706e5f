"""Sender and text routing by dictionary joins. Senders are routed once each, then joined back by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.small import small
from ..functions.text import containing
from . import gates

#: (prio, institution, sender pattern, forced type, kind): a fund goes before the bank whose name it shares.
INSTITUTIONS = [
    (1, "Alpha Mutual Fund", r"(?i)\bALPHMF", "INVESTMENT", "fund"),
    (2, "Alpha Bank", r"(?i)\bALPH(?:A|BK)", None, "bank"),
    (3, "Beta Bank", r"(?i)\bBETA(?:BK)?", None, "bank"),
    (4, "Gamma Card", r"(?i)\bGAMCRD", "CREDIT", "card"),
    (5, "Delta Bill Pay", r"(?i)\bDELBIL", "TRANSFER", "bill"),
    (6, "UPI", r"(?i)\bUPI\b", None, "upi"),
]
PRIORITY = {"BANK": 100, "TRAVEL": 80, "DELIVERY": 70, "OFFERS": 60, "EVENT": 50, "BILL": 40}


def institutions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTITUTIONS, schema.INSTITUTION)


def distinct_senders(messages: DataFrame) -> DataFrame:
    return messages.select("sender").where("sender IS NOT NULL").distinct()


def route_sender(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds institution, type_override and kind: of the rules whose pattern a sender matches, that of the least prio.

    ``rules`` has a row an institution; the pattern join sees distinct senders only.
    """
    hit = distinct_senders(messages).join(small(rules), F.expr("sender RLIKE sender_pattern"))
    best = hit.groupBy("sender").agg(F.min(F.struct("prio", "institution", "type_override", "kind")).alias("r")).select("sender", "r.institution", "r.type_override", "r.kind")
    return messages.join(best, "sender", "left")


def known_sender(messages: DataFrame, rules: DataFrame) -> DataFrame:
    hit = distinct_senders(messages).join(small(rules), F.expr("sender RLIKE sender_pattern")).select("sender").distinct()
    return messages.join(hit, "sender", "left_semi")


def fragments(senders: DataFrame) -> DataFrame:
    """(sender, pos, fragment) of each sender's parts between - and _; the whole sender comes last."""
    parts = F.concat(F.split(F.lower("sender"), "[-_]"), F.array(F.lower("sender")))
    return senders.select("sender", F.posexplode(parts).alias("pos", "fragment"))


def first_fragment_hit(messages: DataFrame, dictionary: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: the dictionary's (fragment, value) at the first fragment of the sender that it has."""
    hit = fragments(distinct_senders(messages)).join(dictionary, "fragment").groupBy("sender").agg(F.min(F.struct("pos", value))[value].alias(name))
    return messages.join(hit, "sender", "left")


def strongest_category(dictionary: DataFrame) -> DataFrame:
    """(fragment, category): of an alias in several categories, that of the highest priority."""
    prio = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return dictionary.groupBy(F.lower("alias").alias("fragment")).agg(F.max(F.struct(prio[F.col("category")].alias("p"), "category"))["category"].alias("category"))


def sender_category(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    return first_fragment_hit(messages, strongest_category(dictionary), "category", "sender_category")


def bank_by_fragment(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``dictionary`` (alias, bank, prio): of equal aliases the least prio counts."""
    one = dictionary.groupBy(F.lower("alias").alias("fragment")).agg(F.min(F.struct("prio", "bank"))["bank"].alias("bank"))
    return first_fragment_hit(messages, one, "bank", "bank_exact")


def canonical_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(raw, bank): the known name that is equal, else the only one that begins with raw and a space, else raw in title case."""
    # a name's beginnings that end before a space, and the whole of it, make the condition an equality
    words = F.split(F.lower("name"), " ")
    begins = known.select("name").distinct().select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("begin"))
    pairs = names.select("raw").distinct().join(begins, F.lower("raw") == F.col("begin"), "left")
    exact = F.max(F.when(F.lower("name") == F.lower("raw"), F.col("name")))
    longer = F.collect_set(F.when(F.lower("name") != F.lower("raw"), F.col("name")))
    return pairs.groupBy("raw").agg(exact.alias("e"), longer.alias("l")).select("raw", F.coalesce("e", F.when(F.size("l") == 1, F.get("l", F.lit(0))), F.initcap(F.lower("raw"))).alias("bank"))


def bank_by_substring(messages: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Adds bank_alias: the first alias (alias, raw, prio) that the sender contains, under its canonical name."""
    resolved = aliases.join(canonical_names(aliases, known), "raw")
    senders = distinct_senders(messages).withColumn("_s", F.lower("sender"))
    held = containing(senders, "_s", resolved.withColumn("_a", F.lower("alias")), "_a")
    hit = held.groupBy("sender").agg(F.min(F.struct("prio", "bank"))["bank"].alias("bank_alias"))
    return messages.join(hit, "sender", "left")


BANK_PATTERNS = (("Alpha Bank", r"(?i)\balpha\s*bank\b"), ("Beta Bank", r"(?i)\bbeta\s*bank\b"), ("Gamma Card", r"(?i)\bgamma\b.*\bcard\b"), ("Sigma Bank", r"(?i)\bsigma\s*bk\b"))


#: A part that every lower-case text of a bank's pattern has, by bank.
_BANK_NEEDS = {"Alpha Bank": "alpha", "Beta Bank": "beta", "Gamma Card": "gamma", "Sigma Bank": "sigma"}


def bank_by_pattern(body: Column, sender: Column, lower: Column | None = None) -> Column:
    low, out = F.lower(body) if lower is None else lower, None
    for bank, pattern in BANK_PATTERNS:
        test = (gates.has(low, _BANK_NEEDS[bank]) & body.rlike(pattern)) | sender.rlike(pattern)
        out = F.when(test, bank) if out is None else out.when(test, bank)
    return out


def bank_of_sender(messages: DataFrame, exact: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Adds bank_exact and bank_alias, which the sender alone decides."""
    return bank_by_substring(bank_by_fragment(messages, exact), aliases, known)


def bank_name(messages: DataFrame, exact: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Adds bank_exact, bank_alias, bank_pattern and their first non-null, bank_name."""
    out = bank_of_sender(messages, exact, aliases, known)
    out = out.withColumn("bank_pattern", bank_by_pattern(F.col("body"), F.col("sender")))
    return out.withColumn("bank_name", F.coalesce("bank_exact", "bank_alias", "bank_pattern"))


def offer_category(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    one = dictionary.groupBy(F.lower("alias").alias("fragment")).agg(F.min("offer").alias("offer"))
    return first_fragment_hit(messages, one, "offer", "offer_category")


def by_handle(df: DataFrame, address: str, providers: DataFrame) -> DataFrame:
    """Adds provider: what (handle, provider) has for the text after the last @."""
    return df.withColumn("handle", F.when(F.contains(F.col(address), F.lit("@")), F.lower(F.substring_index(address, "@", -1)))).join(small(providers.select(F.lower("handle").alias("handle"), "provider").dropDuplicates(["handle"])), "handle", "left")


def place_codes(spans: DataFrame, places: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, code, codes): code of the first word of a text that is a place, and all its places' codes in text order."""
    words = spans.select(key, F.posexplode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("pos", "word"))
    hit = words.join(small(places.select(F.lower("word").alias("word"), "code").dropDuplicates(["word"])), "word")
    return hit.groupBy(key).agg(F.min(F.struct("pos", "code"))["code"].alias("code"), F.sort_array(F.collect_list(F.struct("pos", "code")))["code"].alias("codes"))


def gazetteer(spans: DataFrame, phrases: DataFrame, places: DataFrame, key: str = "id", text: str = "text", longest: int | None = None) -> DataFrame:
    """(key, code): a phrase of several words that the text has (the least prio), else its first place word.

    Phrases of over ``longest`` words are left out; without it, none are.
    """
    from .corpus import phrase_matches

    known = phrases.select(F.lower("phrase").alias("phrase"), F.col("code").alias("pcode"), "prio")
    many = phrase_matches(spans, known, longest, key, text).join(known, "phrase").groupBy(key).agg(F.min(F.struct("prio", "pcode"))["pcode"].alias("pcode"))
    one = place_codes(spans, places, key, text).select(key, "code")
    return many.join(one, key, "full").select(key, F.coalesce("pcode", "code").alias("code"))


#: Which kind of token decides a message's category, in order.
TOKEN_CATEGORIES = ("OTP", "TRAVEL", "DELIVERY", "OFFERS", "STOCK")


def category_of(tags: Column, fallback: Column, default: str = "BANK") -> Column:
    """The first of the token categories that a map has as a key, else ``fallback``, else ``default``."""
    return F.coalesce(*[F.when(F.map_contains_key(tags, c), c) for c in TOKEN_CATEGORIES], fallback, F.lit(default))


def category(messages: DataFrame, tokens: DataFrame, fallback: str = "sender_category", default: str = "BANK", key: str = "msg_id") -> DataFrame:
    """Adds category: the first of the token categories that ``tokens`` (key, type) has, else ``fallback``, else ``default``."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(TOKEN_CATEGORIES) for x in (c, i)])
    best = tokens.where(F.col("type").isin(*TOKEN_CATEGORIES)).groupBy(key).agg(F.min(F.struct(order[F.col("type")].alias("o"), "type"))["type"].alias("_token_category"))
    return messages.join(best, key, "left").withColumn("category", F.coalesce("_token_category", fallback, F.lit(default))).drop("_token_category")


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key; ties by msg_id."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").desc(), "msg_id"))).where("_n = 1").drop("_n")
