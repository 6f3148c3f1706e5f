"""Fields of a message body as columns: literal patterns in a fixed order, the first that yields a usable value wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as C
from . import gates

NUMBER = r"(-?\d[\d,]*(?:\.\d{1,2})?)"
RUPEES = (rf"(?i)\brs\.?\s*{NUMBER}", rf"(?i)\binr\s*{NUMBER}", rf"₹\s*{NUMBER}")
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
CODES = "USD EUR GBP JPY AED SGD AUD CAD HKD NZD CHF SAR QAR THB MYR".split()
#: Signs that stand before a number, the longest first, and their codes.
SIGNS = (("US$", "USD"), ("HK$", "HKD"), ("NZ$", "NZD"), ("S$", "SGD"), ("A$", "AUD"), ("C$", "CAD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"))
NAMES = (("dollars?", "USD"), ("euros?", "EUR"), ("pounds?", "GBP"), ("yen", "JPY"), ("dirhams?", "AED"), ("rupees?", "INR"))
#: After a code: white space, or a number at once, which then doesn't run on as an identifier does ("cad5ef@abc").
_OF_CODE = r"(?:\s+|(?!\d++(?:[.,]\d++)*+(?!(?:k|mn?|bn|lakhs?|lacs?|crores?)\b)[a-z_@]))"
FOREIGN = tuple(rf"(?i)\b{c}{_OF_CODE}{NUMBER}" for c in CODES) + tuple(rf"{s.replace('$', chr(92) + '$')}\s*{NUMBER}" for s, _ in SIGNS if s != "₹")


def first(c: Column, patterns: tuple[str, ...], usable: Callable[[Column], Column] | None = None, needs: tuple[tuple[str, ...], ...] | None = None, lower: Column | None = None) -> Column:
    """The first pattern's group 1 that ``usable`` doesn't turn into null.

    Patterns are tried in order, each once, up to the first that yields something. ``needs`` has for each pattern lower-case
    parts of which one is in every text that it matches: a text without them isn't searched.
    """
    lower = F.lower(c) if needs and lower is None else lower
    tries = []
    for i, p in enumerate(patterns):
        found = F.regexp_extract(c, p, 1)
        found = F.when(gates.has(lower, *needs[i]), found) if needs else found
        tries.append(_once(found, usable))
    return F.coalesce(*tries)


def _once(found: Column, usable: Callable[[Column], Column] | None = None) -> Column:
    """What ``usable`` makes of a text, null for an empty one; as an element of an array, the text is found once, however often it is looked at."""
    rows = F.filter(F.array(found), lambda x: x != "")
    return F.get(rows if usable is None else F.transform(rows, usable), F.lit(0))


_FOREIGN_AMOUNT = r"(?i)(?:(?=[" + "".join(sorted({c[0] for c in CODES})) + r"])\b(?:" + "|".join(CODES) + ")" + _OF_CODE + r"|(?:HK|NZ|S|A|C)?[$€£¥]\s*)" + NUMBER
_AMOUNT_NEEDS = (("rs",), ("inr",), ("₹",), tuple(c.lower() for c in CODES) + tuple("$€£¥"))


def amount(body: Column, lower: Column | None = None) -> Column:
    """Above 0; rupee forms go before other currencies."""
    return first(body, (*RUPEES, _FOREIGN_AMOUNT), lambda v: C.parse_amount(v), _AMOUNT_NEEDS, lower)


def negated(body: Column, lower: Column | None = None) -> Column:
    low = F.lower(body) if lower is None else lower
    return F.coalesce(gates.has(low, "not", "never", "n't") & low.rlike(r"\b(?:not|never|n't)\s+(?:been\s+)?(?:debited|credited|charged|deducted|paid)\b"), F.lit(False))


# The verbs, besides "debited" and "credited", that say which way money goes.
OUT_VERBS = ("withdrawn", "spent", "charged", "paid", "purchase", "deducted")
IN_VERBS = ("deposited", "received", "refund")
# More forms of them.
OUT_VERBS += ("purchased",)
IN_VERBS += ("refunded",)


def direction(body: Column, lower: Column | None = None) -> Column:
    """INVESTMENT, EXPENSE or INCOME; in a two-account message the first verb decides."""
    b = F.lower(body) if lower is None else lower
    return F.when(gates.is_investment(body, lower=b), "INVESTMENT").otherwise(_by_verbs(body, b))


def _by_verbs(body: Column, b: Column) -> Column:
    out = gates.any_of(body, OUT_VERBS, lower=b)
    debited, credited = F.locate("debited", b), F.locate("credited", b)
    both = (debited > 0) & (credited > 0)
    got = gates.any_of(body, IN_VERBS, lower=b)
    cashback = gates.has(b, "cashback") & b.rlike(r"\bcashback\b") & ~b.rlike(r"\bearn cashback\b")
    return (
        F.when(both, F.when(debited < credited, "EXPENSE").otherwise("INCOME"))
        .when((debited > 0) | out, "EXPENSE")
        .when((credited > 0) | got | cashback, "INCOME")
    )


ANCHORS = ("to", "from", "at", "for")
_STOP = r"(?=\s+(?:on|at|from|ref|upi|via|dt|txn|utr|rrn)\b|\s*[;]|\.(?:\s|$)|,\s|$)"


LEGAL_FORMS = ("pvt", "private", "ltd", "limited", "llp", "llc", "inc", "gmbh", "plc")
#: Where a name ends: a reference or channel word, a date or time of day, a dash between spaces, a bracket that closes the text.
_NOT_NAME = r"\s(?i:ref|upi|utr|rrn|txn)\b|\s(?:on|at)\s\d|\s-\s|\s?\([^()]*\)$"


def cleanup(c: Column) -> Column:
    """A name up to the first word that begins what isn't part of it, without legal forms, a last bracket and edge punctuation."""
    name = F.regexp_extract(C.collapse(c), rf"^(.+?)(?:{_NOT_NAME}|$)", 1)
    name = F.regexp_replace(name, rf"(?i)(?:[\s,]+(?:{'|'.join(LEGAL_FORMS)})\b\.?)+$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"^[\s\p{Punct}&&[^&]]+", ""), r"[\s\p{Punct}&&[^)&]]+$", "")
    return F.when(c.rlike(r"\A[A-Za-z0-9]+\z"), c).otherwise(name)  # of one plain word there is nothing to cut


def valid_merchant(c: Column) -> Column:
    """Cleaned up, null if that is no merchant."""
    return F.get(F.filter(F.transform(F.array(c), cleanup), gates.is_merchant), F.lit(0))


def merchant(body: Column, anchors: tuple[str, ...] = ANCHORS, lower: Column | None = None) -> Column:
    return first(body, tuple(rf"(?is)\b{a}\s+(.{{1,300}}?){_STOP}" for a in anchors), valid_merchant, tuple(tuple(a + x for x in " \n\t\r\f\v") for a in anchors), lower)


def reference(body: Column, lower: Column | None = None) -> Column:
    return first(body, (r"(?i)\b(?:upi\s*)?ref(?:erence)?(?:\s*(?:no|number|id))?[\s.:#-]*(\d{6,22})\b", r"(?i)\b(?:utr|rrn)(?:\s*(?:no|number))?[\s.:#-]*([A-Z0-9]{8,22})\b", r"(?i)\b(?:txn|transaction)\s*(?:id|no|number)[\s.:#-]*([A-Z0-9]{6,22})\b"), None, (("ref",), ("utr", "rrn"), ("txn", "transaction")), lower)


_HOLDER = r"(?:a(?:/c|cct|ccount)|card)"
_HOLDERS = ("a/c", "acct", "account", "card")


def account_tail(body: Column, lower: Column | None = None) -> Column:
    """The last four digits of the account or card, as far as they belong to no date."""
    tails = (rf"(?i)(?=[ac])\b{_HOLDER}\s*(?:no\.?|number)?\s*[:.]?\s*([x*]*\d{{3,}})\b", rf"(?i)(?=[ac])\b{_HOLDER}\s+ending\s+(?:with\s+|in\s+)?([x*]*\d{{3,4}})\b", r"(?i)(?=[x*])\b[x*]{2,}(\d{3,4})\b")
    return first(body, tails, lambda t: F.get(F.filter(F.array(C.last4_digits(t)), lambda d: gates.is_account_tail(body, d, lower)), F.lit(0)), (_HOLDERS, ("ending",), ("xx", "x*", "*x", "**")), lower)


def other_account(body: Column, lower: Column | None = None) -> Column:
    """The second account's tail of a message about two."""
    low = F.lower(body) if lower is None else lower
    tail = F.regexp_extract(body, rf"(?is)(?=[ac])\b{_HOLDER}\s*[x*]*\d{{3,}}\b.*?\b{_HOLDER}\s*([x*]*\d{{3,}})\b", 1)
    return _once(F.when(low.rlike(r"(?s)(?:a/c|acc|card).*(?:a/c|acc|card)"), tail), C.last4_digits)


def masked_tail(c: Column) -> Column:
    """Of a masked account text: letters of a mask in lower case, short tails filled with 0, stars alone give null."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 3, F.right(digits, F.lit(4))).when(F.length(digits) > 0, F.concat(F.lower(F.regexp_replace(c, r"[^A-Za-z]", "")), F.lpad(digits, 4, "0")))


_IS = r"(?:\s+(?:in|of|for)\s+(?:a/c|acct|account|card)\s+\S+)?\s*(?:is|:|-|=)?\s*"
_MONEY = r"(?:rs\.?|inr|₹)\s*"
_BAL = {r"avl\.?\s*bal(?:ance)?": "avl", r"avail(?:able)?\.?\s*bal(?:ance)?": "avail", r"(?:closing|clear|updated|current)\s*bal(?:ance)?": "bal", r"new\s*bal(?:ance)?": "new", r"bal(?:ance)?": "bal"}
BALANCES = tuple(rf"(?i)\b{w}{_IS}{_MONEY}{NUMBER}" for w in _BAL)


def balance(body: Column, lower: Column | None = None) -> Column:
    """May be 0; a DR suffix makes it negative."""
    def signed(v: Column) -> Column:
        n = C.parse_amount(F.regexp_extract(v, NUMBER, 1), positive=False)
        return F.when(F.lower(v).endswith("dr"), -F.abs(n)).otherwise(n)

    low = F.lower(body) if lower is None else lower
    with_suffix = tuple(p.removesuffix(NUMBER) + rf"({NUMBER}(?:\s*dr\b)?)" for p in BALANCES)
    return F.when(gates.has(low, "bal"), first(body, with_suffix, signed, tuple((n,) for n in _BAL.values()), low))


def credit_limit(body: Column, lower: Column | None = None) -> Column:
    words = (r"avl\.?\s*(?:credit\s*)?(?:limit|lmt)", r"available\s*(?:credit\s*)?limit", r"(?:credit\s*)?limit\s*available", r"avbl\.?\s*(?:limit|lmt)", r"remaining\s*limit", r"total\s*limit")
    low = F.lower(body) if lower is None else lower
    return F.when(gates.has(low, "limit", "lmt"), first(body, tuple(rf"(?i)\b{w}{_IS}{_MONEY}{NUMBER}" for w in words), lambda v: C.parse_amount(v, positive=False)))


def currency(body: Column, lower: Column | None = None) -> Column:
    """A code before an amount (no month), a sign on a digit, a currency's name; INR without any. Few patterns, then lookups."""
    def looked_up(pattern: str, table: tuple[tuple[str, str], ...]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in table for x in pair]), F.upper(F.regexp_extract(body, pattern, 1)))

    low = F.lower(body) if lower is None else lower
    lead = F.upper(F.regexp_extract(body, r"(?i)\b([a-z]{3})\s*\d[\d,.]*\s+spent\b", 1))
    signs = "|".join(s.replace("$", r"\$") for s, _ in SIGNS)
    names = tuple((n.replace("?", "").upper(), c) for n, c in NAMES) + tuple((n.replace("s?", "").upper(), c) for n, c in NAMES if "s?" in n)
    return F.coalesce(
        F.when(gates.has(low, "rs", "inr", "₹") & body.rlike(r"(?i)(?:(?=[ri])\b(?:rs\.?|inr)|₹)\s*\d"), "INR"),
        F.when(gates.has(low, "spent") & (lead != "") & ~lead.isin(*MONTHS), lead),
        F.when(gates.has(low, *(c.lower() for c in CODES)), looked_up(rf"(?i)\b({'|'.join(CODES)}){_OF_CODE}\d", tuple((c, c) for c in CODES))),
        F.when(gates.has(low, "$", "€", "£", "¥", "₹"), looked_up(rf"({signs})\s?\d", SIGNS)),
        F.when(gates.has(low, "dollar", "euro", "pound", "yen", "dirham", "rupee"), looked_up(rf"(?i)\d\s*({'|'.join(n for n, _ in NAMES)})\b", names)),
        F.lit("INR"),
    )


def txn_id(sender: Column, value: Column, body: Column, user: Column | None = None, ts: Column | None = None) -> Column:
    """SHA-256 of sender, amount with two decimals and the first 16 hex digits of the body's; ``ts`` tells days apart."""
    parts = [F.coalesce(sender, F.lit("")), F.coalesce(value.cast("decimal(18,2)").cast("string"), F.lit("")), F.substring(F.sha2(F.coalesce(body, F.lit("")), 256), 1, 16)]
    if ts is not None:
        parts.append(F.coalesce(F.unix_seconds(ts).cast("string"), F.lit("")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def event_key(body: Column, sender: Column, ts: Column) -> Column:
    """Alternative key: reference and time, reference, time and balance, time, balance, else sender and timestamp."""
    ref, bal = reference(body), balance(body).cast("string")
    time = F.nullif(F.regexp_extract(body, r"\b(\d{1,2}:\d{2}(?::\d{2})?)\b", 1), F.lit(""))
    parts = (
        F.when(ref.isNotNull() & time.isNotNull(), F.concat_ws("|", F.lit("rt"), ref, time))
        .when(ref.isNotNull(), F.concat_ws("|", F.lit("r"), ref))
        .when(time.isNotNull() & bal.isNotNull(), F.concat_ws("|", F.lit("tb"), time, bal))
        .when(time.isNotNull(), F.concat_ws("|", F.lit("t"), time))
        .when(bal.isNotNull(), F.concat_ws("|", F.lit("b"), bal))
        .otherwise(F.concat_ws("|", F.lit("s"), sender, F.unix_seconds(ts).cast("string")))
    )
    return F.sha2(parts, 256)


# --- mandates, rich types, categories -------------------------------------------------------------------------------


def mandate_id(body: Column, lower: Column | None = None) -> Column:
    low = F.lower(body) if lower is None else lower
    return F.lower(F.when(gates.has(low, "umn"), F.nullif(F.regexp_extract(body, r"(?i)\bUMN\s*[:=-]?\s*([A-Za-z0-9]+@[A-Za-z0-9.]+)", 1), F.lit(""))))


def mandate_event(body: Column, lower: Column | None = None) -> Column:
    b = F.lower(body) if lower is None else lower
    return F.when(mandate_id(body, b).isNotNull(), F.when(b.rlike(r"\b(?:cancelled|canceled|revoked|terminated)\b"), "cancelled").otherwise("active"))


_TOWARDS = r"(?is)\btowards\s+(.{1,120}?)\s+for\s+(?:(?:rs\.?|inr|₹)\s*)?"


def mandate_merchant(body: Column, lower: Column | None = None) -> Column:
    return F.when(mandate_id(body, lower).isNotNull(), valid_merchant(F.nullif(F.regexp_extract(body, _TOWARDS + r"\d", 1), F.lit(""))))


def mandate_amount(body: Column, lower: Column | None = None) -> Column:
    return F.when(mandate_id(body, lower).isNotNull(), C.parse_amount(F.nullif(F.regexp_extract(body, _TOWARDS + NUMBER, 2), F.lit(""))))


DATE_FORMATS = (("yyyy-MM-dd", r"\b(\d{4}-\d{2}-\d{2})\b"), ("dd-MM-yyyy", r"\b(\d{2}-\d{2}-\d{4})\b"), ("dd/MM/yyyy", r"\b(\d{2}/\d{2}/\d{4})\b"), ("dd-MMM-yyyy", r"\b(\d{2}-[A-Za-z]{3}-\d{4})\b"), ("dd-MMM-yy", r"\b(\d{2}-[A-Za-z]{3}-\d{2})\b"), ("dd/MM/yy", r"\b(\d{2}/\d{2}/\d{2})\b"))


def dated(body: Column) -> tuple[Column, Column]:
    """The first date of the first form that occurs, and that form."""
    def one(fmt: str, pattern: str) -> Column:
        return F.to_date(F.try_to_timestamp(F.initcap(F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))), F.lit(fmt)))

    date = F.coalesce(*(one(f, p) for f, p in DATE_FORMATS))
    form = F.lit(None).cast("string")
    for f, p in reversed(DATE_FORMATS):
        form = F.when(one(f, p).isNotNull(), f).otherwise(form)
    return date, form


_AUTO, _AUTO_NEEDS = r"\b(?:auto-?debit(?:ed)?|autopay|e-?mandate|standing instruction|nach|ecs)\b", ("auto", "mandate", "standing instruction", "nach", "ecs")


def rich_type(body: Column, lower: Column | None = None, investment: Column | None = None) -> Column:
    """One of 11 types, in order of precedence; expiry notices have none. ``investment`` is the column of ``gates.is_investment``, where there is one."""
    b = F.lower(body) if lower is None else lower
    investment = gates.is_investment(body, lower=b) if investment is None else investment
    out = gates.bounded(b, "debited", "spent", "paid", "charged", "deducted", "withdrawn", "transferred", "sent", "purchase", "purchased")
    come = gates.bounded(b, "credited", "received", "deposited", "refund", "refunded")
    wallet = gates.bounded(b, "wallet")
    return (
        F.when(gates.is_expiry_notice(body, b), None)
        .when(investment & (out | come), "INVESTMENT")
        .when(wallet & b.rlike(r"\b(?:added|loaded|credited|top-?up|topped)\b"), "WALLET_CREDIT")
        .when(wallet & out, "WALLET_DEBIT")
        .when(gates.is_balance_notice(body, b), "BALANCE_UPDATE")
        .when(gates.has(b, "recharge") & b.rlike(r"\brecharge[d]?\b") & (out | gates.bounded(b, "successful")), "RECHARGE")
        .when(gates.bounded(b, "salary") & come, "SALARY")
        .when(gates.has(b, *_AUTO_NEEDS) & b.rlike(_AUTO) & out, "AUTO_DEBIT")
        .when(gates.bounded(b, "atm") & out, "ATM_WITHDRAWAL")
        .when(gates.bounded(b, "neft", "imps", "rtgs", "aeps") & out & ~come, "TRANSFER")
        .when(~investment, _by_verbs(body, b))
    )


SUBCATEGORIES = (
    ("otp", r"\b(?:otp|one time password|verification code)\b"), ("decline", r"\b(?:declined|failed|rejected)\b"), ("refund", r"\brefund(?:ed)?\b"), ("cashback", r"\bcashback\b"), ("emi", r"\bemi\b"), ("incrdlmt", r"\b(?:credit )?limit (?:has been )?(?:increased|enhanced)\b"),
    ("autdbt", r"\b(?:auto-?debit(?:ed)?|autopay|e-?mandate|standing instruction|nach|ecs)\b"), ("wallet", r"\bwallet\b"), ("atm", r"\batm\b"), ("cheque", r"\b(?:cheque|chq)\b"), ("aeps", r"\baeps\b"), ("upi", r"\b(?:upi|vpa)\b"), ("neft", r"\bneft\b"), ("imps", r"\bimps\b"), ("rtgs", r"\brtgs\b"), ("deposit", r"\b(?:deposit|deposited)\b"), ("transfer", r"\b(?:transfer|transferred)\b"),
)


def labelled(c: Column, table: tuple[tuple[str, str], ...], lower: Column | None = None) -> Column:
    """The first label whose pattern occurs."""
    low, out = F.lower(c) if lower is None else lower, None
    for label, pattern in table:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out


def subcategory(body: Column, lower: Column | None = None) -> Column:
    return labelled(body, SUBCATEGORIES, lower)


def display_payee(brand: Column, vendor: Column, bank: Column, sender: Column) -> Column:
    return F.coalesce(brand, vendor, bank, sender)


def address_of(body: Column) -> Column:
    """A payment address name@handle."""
    return F.lower(F.when(gates.has(body, "@"), F.nullif(F.regexp_extract(body, r"(?i)\b([a-z0-9][a-z0-9._-]{1,60}@[a-z][a-z0-9]{1,20})\b(?!\.)", 1), F.lit(""))))


def address_payee(address: Column) -> Column:
    """The name part without a "upi" in front; generated codes give null, numbers stay."""
    name = F.regexp_replace(F.substring_index(address, "@", 1), r"^upi[._-]?", "")
    return F.when((name == "") | name.rlike(r"^(?:q|qr|bqr)\d{6,}") | name.rlike(r"^[a-z]{2,6}qr\w*\d{4,}"), None).otherwise(name)


ALIASES = (("Green Grocer", "grngrcr"), ("Metro Rail", "metrorail"), ("City Cab", "citycab"), ("Book Barn", "bookbarn"))
GATEWAYS = ("payg8", "fastpg", "netpay")


def payee_alias(address: Column) -> Column:
    """Display brand of an address: a known alias in its name, a gateway, only digits, else the name."""
    name = F.substring_index(address, "@", 1)
    out = F.when(address.isNull(), None)
    for brand, alias in ALIASES:
        out = out.when(F.contains(name, F.lit(alias)), brand)
    for gateway in GATEWAYS:
        out = out.when(F.contains(name, F.lit(gateway)), "Online Payment")
    return out.when(name.rlike(r"^\d+$"), "Individual").otherwise(F.initcap(F.regexp_replace(name, "[._-]+", " ")))


CHANNELS = (
    ("ATM Cash", r"\batm\b"), ("NEFT Transfer", r"\bneft\b"), ("RTGS Transfer", r"\brtgs\b"), ("IMPS Transfer", r"\bimps\b"), ("Standing Instruction", r"\bstanding instruction\b"), ("Cash Deposit", r"\bcash deposit(?:ed)?\b"), ("Bank Charges", r"\bcharges?\b"),
    ("Electricity Bill", r"\belectricity bill\b"), ("Water Bill", r"\bwater bill\b"), ("Bill Payment", r"\bbill\b"), ("Mobile Recharge", r"\brecharge\b"), ("UPI Transfer", r"\bupi\b"),
)


def channel_label(body: Column, lower: Column | None = None) -> Column:
    """What to show where no name is found; an ATM's place and a recharged number's last digits are added."""
    label = labelled(body, CHANNELS, lower)
    place = F.nullif(F.regexp_extract(body, r"(?i)\batm\s+(?:at\s+)?([A-Z][A-Z0-9]{2,20})\b", 1), F.lit(""))
    phone = F.nullif(F.regexp_extract(body, r"\b\d{6}(\d{4})\b", 1), F.lit(""))
    return F.when((label == "ATM Cash") & place.isNotNull(), F.concat_ws(" ", label, place)).when((label == "Mobile Recharge") & phone.isNotNull(), F.concat(label, F.lit(" XXXXXX"), phone)).otherwise(label)


def narration(body: Column, lower: Column | None = None) -> Column:
    """Struct (channel, reference, counterparty) of a delimited narration."""
    low = F.lower(body) if lower is None else lower
    slash = F.when(gates.has(body, "UPI/", "IMPS/", "NEFT/", "RTGS/"), F.nullif(F.regexp_extract(body, r"\b((?:UPI|IMPS|NEFT|RTGS)/[^\s/]+/[^\s/]+(?:/[^./;]+)?)", 1), F.lit("")))
    parts = F.split(slash, "/")
    phone = F.when(gates.has(low, "mtfr/"), F.nullif(F.regexp_extract(body, r"(?i)\bmTFR/(\d{10}/[^./;]+)", 1), F.lit("")))
    bracket = F.when(gates.has(body, "[NEFT-", "[RTGS-", "[IMPS-"), F.nullif(F.regexp_extract(body, r"\[((?:NEFT|RTGS|IMPS)-[^\]]+)\]", 1), F.lit("")))
    p, b = F.split(phone, "/"), F.split(bracket, "-")
    second = F.get(parts, 1)
    is_ref = F.get(parts, 2).rlike(r"^\d+$")
    channel = F.when(slash.isNotNull(), F.get(parts, 0)).when(phone.isNotNull(), "MTFR").when(bracket.isNotNull(), F.get(b, 0))
    ref = F.when(slash.isNotNull(), F.when(is_ref, F.get(parts, 2)).when(second.rlike(r"^\d+$"), second))
    name = F.when(slash.isNotNull(), F.when(is_ref, F.get(parts, 3)).otherwise(F.get(parts, 2))).when(phone.isNotNull(), F.get(p, 1)).when(bracket.isNotNull(), F.get(b, 1))
    return F.struct(channel.alias("channel"), ref.alias("reference"), F.trim(name).alias("counterparty"))


def two_accounts(body: Column, lower: Column | None = None) -> Column:
    """Struct (type, own, other) of "A/c x debited ... and A/c y credited": the first verb decides."""
    b = F.lower(body) if lower is None else lower
    debited, credited = F.locate("debited", b), F.locate("credited", b)
    both = (debited > 0) & (credited > 0)
    kind = F.when(both, F.when(debited < credited, "EXPENSE").otherwise("INCOME"))
    return F.struct(kind.alias("type"), F.when(both, account_tail(body, b)).alias("own"), F.when(both, other_account(body, b)).alias("other"))


#: Fields of message families: name, pattern. A family's fields are looked for in its messages alone.
PACKS = {
    "otp": (r"\b(?:otp|one time password|verification code)\b", {"otp_code": r"(?i)\b(?:otp|code|password)\s*(?:is|:)\s*(\d{4,8})\b", "otp_valid": r"(?i)\bvalid\s+for\s+(\d+\s+(?:minutes?|mins?|hours?))\b"}),
    "travel": (r"\b(?:pnr|flight|boarding|train no|bus no)\b", {"pnr": r"(?i)\bpnr\s*[:.-]?\s*([A-Z0-9]{6,10})\b", "flight": r"(?i)\bflight\s+([A-Z0-9]{2}-?\d{2,4})\b", "departs": r"(?i)\bdep(?:arts|arture)?\s*[:.]?\s*(\d{1,2}:\d{2})", "arrives": r"(?i)\barr(?:ives|ival)?\s*[:.]?\s*(\d{1,2}:\d{2})", "fare": r"(?i)\bfare\s*(?:is|:)?\s*(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)", "vehicle": r"(?i)\b(?:train|bus)\s+no\.?\s*([A-Z0-9]{3,8})\b", "gate": r"(?i)\bgate\s+([A-Z]?\d{1,3}[A-Z]?)\b"}),
    "delivery": (r"\b(?:order|shipment|package|parcel|awb)\b", {"order_no": r"(?i)\border\s*(?:no\.?|id|#)?\s*[:#]?\s*([A-Z0-9-]*\d[A-Z0-9-]{4,})\b", "tracking": r"(?i)\b(?:awb|tracking)\s*(?:no\.?|id)?\s*[:#]?\s*([A-Z0-9]{8,20})\b", "delivery_status": r"(?i)\b(shipped|out for delivery|delivered|dispatched)\b", "item": r"(?i)\bfor\s+item\s+(\S+)"}),
    "bill": (r"\b(?:bill|emi|policy|recharge|mandate)\b", {"mandate_amount": r"(?i)\bmandate\b[^.]{0,40}?\b(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)", "bill_amount": r"(?i)\bbill\s+(?:amount\s+)?(?:of\s+)?(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)", "emi_amount": r"(?i)\bemi\s+(?:of\s+)?(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)", "due_date": r"(?i)\bdue\s+(?:on|date|by)\s*[:.]?\s*(\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4})", "policy_no": r"(?i)\bpolicy\s*(?:no\.?|number)?\s*[:#]?\s*([A-Z0-9]{6,15})\b", "recharge_amount": r"(?i)\brecharge\s+of\s+(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)"}),
    "offer": (r"\b(?:offers?|cashback|discount|coupon|promo)\b", {"cashback": r"(?i)\bcashback\s+of\s+(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)", "discount": r"(?i)\b(\d{1,3}%)\s+(?:off|discount)\b", "offer_code": r"(?i)\b(?:use\s+code|coupon|promo\s+code)\s*[:]?\s*([A-Z0-9]{4,12})\b"}),
    "telecom": (r"\b(?:data|pack|balance)\b.*\b(?:gb|mb|validity|pack)\b", {"data_left": r"(?i)\b(\d+(?:\.\d+)?\s*(?:GB|MB))\s+(?:data\s+)?(?:left|remaining)\b", "pack_balance": r"(?i)\bpack\s+balance\s*(?:is|:)?\s*(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)"}),
    "holdings": (r"\b(?:nav|folio|margin)\b", {"nav": r"(?i)\bnav\s*(?:of|is|:)?\s*(?:rs\.?|inr)?\s*(\d[\d,]*(?:\.\d{1,4})?)", "folio": r"(?i)\bfolio\s*(?:no\.?)?\s*[:#]?\s*([A-Z0-9/]{5,15})\b", "margin": r"(?i)\bmargin\s*(?:of|is|:)?\s*(?:rs\.?|inr)\s*(\d[\d,]*(?:\.\d{1,2})?)"}),
}


#: Parts of which one is in every lower-case text of a family.
_PACK_NEEDS = {
    "otp": ("otp", "password", "verification"), "travel": ("pnr", "flight", "boarding", "train no", "bus no"), "delivery": ("order", "shipment", "package", "parcel", "awb"), "bill": ("bill", "emi", "policy", "recharge", "mandate"),
    "offer": ("offer", "cashback", "discount", "coupon", "promo"), "telecom": ("data", "pack", "balance"), "holdings": ("nav", "folio", "margin"),
}


def of_family(lower: Column, family: str) -> Column:
    """Whether a lower-case text is of a family."""
    return gates.has(lower, *_PACK_NEEDS[family]) & lower.rlike(PACKS[family][0])


def pack(body: Column, family: str, lower: Column | None = None) -> dict[str, Column]:
    """The fields of a family, null in messages of others."""
    patterns = PACKS[family][1]
    mine = of_family(F.lower(body) if lower is None else lower, family)
    return {k: F.when(mine, F.nullif(F.regexp_extract(body, p, 1), F.lit(""))) for k, p in patterns.items()}
