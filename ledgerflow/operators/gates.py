"""Predicates on message bodies: what is a transaction, a balance or mandate notice, a card payment, a usable merchant.

Keywords match at word boundaries; ``mode="substring"`` tests containment alone, as plain keyword filters do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The length limit and the words of the transaction gates, which decide what counts as a transaction.
# "pls pay" with "min of" is one of them, as a pair.
MOST_CHARS = 5000
VERBS = ("debited", "credited", "withdrawn", "deposited", "spent", "received", "transferred", "paid")
GATE_WORDS = (*VERBS, "withdrawal", "withdrawing", "credit", "debit")
REJECTS = (
    ("otp", ("otp", "one time password", "verification code")),
    ("promo", ("offer", "discount", "cashback offer", "win")),
    ("request", ("has requested", "payment request", "collect request", "requesting payment", "requests rs", "ignore if already paid")),
    ("received_notice", ("have received payment",)),
    ("due", ("is due", "min amount due", "minimum amount due", "in arrears", "is overdue", "ignore if paid")),
)
PAIRED_DUE = ("pls pay", "min of")
# Our own lists from here on.
#: More words of a reason.
MORE_REJECTS = {"otp": ("passcode",), "promo": ("offers",)}
INVESTMENT_WORDS = (
    "mutual fund", "systematic investment", "sip", "folio", "nav", "units allotted", "units purchased", "demat", "ipo allotment", "stock broker", "brokerage",
    "clearing corporation", "securities", "equity purchase", "bond purchase", "gold bond", "pension fund", "provident fund", "recurring deposit", "fixed deposit opened",
)
CARD_WORDS = ("credit card", "debit card", "your card", "card ending", "card no", "card xx", "card x", "pos", "swiped")
ACCOUNT_WORDS = ("a/c", "acct", "account", "savings")
STOP_WORDS = ("the", "your", "you", "a/c", "account", "bank", "card", "upi", "ref", "info", "avl", "bal", "balance", "rs", "inr", "is", "on", "at", "for", "to", "from", "by", "via", "and", "of")


def has(lower: Column, *parts: str) -> Column:
    """Whether one of the parts occurs as a substring: a cheap test before a pattern that can't match without one."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(lower, F.lit(p))
    return found


def bounded(lower: Column, *words: str) -> Column:
    """Whether one of the words occurs between boundaries of words, looked for where one is a part of the text."""
    return has(lower, *_stems(words)) & lower.rlike(rf"\b(?:{'|'.join(words)})\b")


def _stems(words: tuple[str, ...]) -> list[str]:
    """Substrings of which one is in every text that has one of the words: the longest part of each, without those that contain another."""
    longest = sorted({max(w.split(), key=len) for w in words})
    return [w for w in longest if not any(v != w and v in w for v in longest)]


def any_of(c: Column, words: tuple[str, ...], mode: str = "word", lower: Column | None = None) -> Column:
    """Whether ``c`` has one of the words; ``lower`` is the column of its lower-case text, where there is one."""
    lower = F.lower(c) if lower is None else lower
    if mode == "substring":
        return has(lower, *words)
    begins = "".join(sorted({re.escape(w[0]) for w in words}))
    whole = rf"(?=[{begins}])(?<![\p{{L}}\p{{N}}])(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + r")(?![\p{L}\p{N}])"
    return has(lower, *_stems(words)) & lower.rlike(whole)


def stated_reason(body: Column, mode: str = "word", lower: Column | None = None) -> Column:
    """Why a body is no transaction by what it says, null if it may be one or only lacks a verb."""
    out = F.when(body.isNull() | (body == ""), "empty")
    for reason, words in REJECTS:
        test = any_of(body, (*words, *MORE_REJECTS.get(reason, ())), mode, lower)
        if reason == "due":
            test = test | (any_of(body, PAIRED_DUE[:1], mode, lower) & any_of(body, PAIRED_DUE[1:], mode, lower))
        out = out.when(test, reason)
    return out


def reject_reason(body: Column, mode: str = "word", lower: Column | None = None) -> Column:
    """Why a body is no transaction, null if it may be one."""
    return stated_reason(body, mode, lower).when(~(any_of(body, VERBS, mode, lower) | keyword_gate(body, mode, lower)), "no_verb")


def is_transaction(body: Column, mode: str = "word", lower: Column | None = None) -> Column:
    return F.coalesce(reject_reason(body, mode, lower).isNull(), F.lit(False))


def keyword_gate(body: Column, mode: str = "word", lower: Column | None = None) -> Column:
    """The stand-alone gate of 12 keywords."""
    return F.coalesce(any_of(body, GATE_WORDS, mode, lower), F.lit(False))


def short_enough(body: Column) -> Column:
    return F.coalesce(F.length(body) <= MOST_CHARS, F.lit(False))


def has_amount_and_type(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["amount", "type"])


def is_investment(body: Column, mode: str = "word", lower: Column | None = None) -> Column:
    return F.coalesce(any_of(body, INVESTMENT_WORDS, mode, lower), F.lit(False))


def is_card(body: Column, lower: Column | None = None) -> Column:
    """Card words accept, unless an account word comes and no masked digits after "ending"."""
    low = F.lower(body) if lower is None else lower
    named = has(low, "card")
    ending = named & has(low, "ending") & low.rlike(r"card\b.{0,20}\bending\s+(?:with\s+|in\s+)?[x*]*\d{3,4}")
    card = named & low.rlike(r"\b(?:credit|debit)?\s*card\b")
    return F.coalesce(F.when(ending, True).when(any_of(body, ACCOUNT_WORDS, lower=low), False).otherwise(card | any_of(body, ("pos", "swiped"), lower=low)), F.lit(False))


def is_merchant(c: Column) -> Column:
    """Two characters or more with a letter; no stop word, number, address, masked account, cash machine, numbered paper, date or amount."""
    lower = F.lower(F.trim(c))
    begins = (
        r"(?:a/c|acct|account|card|your|my|sip|folio|atm|nav)\b", r"(?:policy|order|item|loan|invoice|mandate)\s+(?:no|number|id)\b", r"(?:item|order|policy)\s+\S*\d", r"[x*]+\d+$", r"\d+\s+(?:minutes?|mins?|hours?|hrs?|days?)$",
        r"\d{1,4}[-/.](?:\d{1,2}|[a-z]{3})[-/.]\d{1,4}$", r"(?:rs|inr|usd)\.?\s*\d",
    )
    bad = lower.isin(*STOP_WORDS) | F.contains(lower, F.lit("@")) | lower.rlike("^(?:" + "|".join(begins) + ")")
    return F.coalesce((F.length(lower) >= 2) & lower.rlike(r"\p{L}") & ~bad, F.lit(False))


def is_account_tail(body: Column, tail: Column, lower: Column | None = None) -> Column:
    """Not when the digits belong to a date in the body, nor a year without an account word."""
    quoted = F.concat(F.lit("(?:"), tail, F.lit(r")[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/](?:\d{1,2}|[A-Za-z]{3})[-/](?:\d\d)?(?:"), tail, F.lit(")(?![0-9])"))
    low = F.lower(body) if lower is None else lower
    year = tail.rlike(r"^20\d\d$") & ~any_of(body, ACCOUNT_WORDS, lower=low) & ~low.rlike(r"\bcard\b")
    return F.coalesce(tail.isNotNull() & ~(year | (tail.rlike(r"^(?:19|20)\d\d$") & F.regexp_like(body, quoted) & ~F.regexp_like(body, F.concat(F.lit("(?i)x+"), tail)))), F.lit(False))


def is_balance_notice(body: Column, lower: Column | None = None) -> Column:
    """Balance words with no transaction verb, or a card statement."""
    low = F.lower(body) if lower is None else lower
    cue = has(low, "bal") & low.rlike(r"\b(?:avl|available|closing|clear|updated|current|outstanding)\b.{0,12}\bbal(?:ance)?\b|\bbalance in\b")
    statement = has(low, "statement") & low.rlike(r"\bcard\b.{0,60}\bstatement\b.{0,60}\boutstanding\b")
    return F.coalesce((cue & ~any_of(body, VERBS, lower=low)) | statement, F.lit(False))


def mandate_notice(body: Column) -> Column:
    """Kind of a mandate notice: declined, upcoming, future_debit, creation, cancellation, e_mandate; else null."""
    b = F.lower(body)
    mandate = b.rlike(r"\b(?:e-?mandate|mandate|autopay|auto-?pay|standing instruction)\b")
    return (
        F.when(mandate & b.rlike(r"\b(?:declined|rejected|failed)\b"), "declined")
        .when(mandate & b.rlike(r"\b(?:upcoming|will be (?:debited|deducted|presented)|scheduled|due on)\b"), "upcoming")
        .when(b.rlike(r"\bwill be (?:debited|deducted)\b"), "future_debit")
        .when(mandate & b.rlike(r"\b(?:cancelled|canceled|revoked)\b"), "cancellation")
        .when(mandate & b.rlike(r"\b(?:created|registered|set ?up|activated)\b"), "creation")
        .when(mandate, "e_mandate")
    )


def is_expiry_notice(body: Column, lower: Column | None = None) -> Column:
    low = F.lower(body) if lower is None else lower
    return F.coalesce(has(low, "expir", "valid") & low.rlike(r"\b(?:expires?|expiring|expired|valid (?:till|until|upto|up to))\b") & ~any_of(body, VERBS, lower=low), F.lit(False))


def recognised(df: DataFrame) -> DataFrame:
    """Rows with a rich type and an amount."""
    return df.where(F.col("rich_type").isNotNull() & F.col("amount").isNotNull())


def recurrence_candidates(df: DataFrame) -> DataFrame:
    """Spending with a merchant and an amount that no mandate accounts for."""
    return df.where(F.col("rich_type").isin("EXPENSE", "AUTO_DEBIT", "WALLET_DEBIT") & F.col("mandate_id").isNull() & F.col("merchant").isNotNull() & F.col("amount").isNotNull())
