"""Positions in texts: dictionary phrases, typed spans, nearness and captures between anchors, on flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.small import small, spread
from ..functions.text import let, longest_phrase, parse_amount
from . import gates

WORD = r"[\p{L}\p{N}]+"


def lowered(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the lower-case text as _low, which is made once, however often it is looked at: an explode isn't merged with what follows."""
    return docs.select("*", F.explode_outer(F.array(F.lower(text))).alias("_low"))


def tokens(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, word): lower-cased words in order, from 0."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("pos", "word"))


def phrase_matches(docs: DataFrame, phrases: DataFrame, longest: int | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, end, phrase): every place of every phrase (phrase, lower-cased words with single spaces), overlapping or not.

    Only words that a phrase has leave the scan; what stands in a row of them is looked up. Phrases of over ``longest`` words
    are left out; without it, none are.
    """
    longest = longest_phrase(phrases) if longest is None else longest
    known = phrases.select("phrase").distinct()
    parts = known.select(F.explode(F.split("phrase", " ")).alias("word")).distinct()
    met = tokens(docs, key, text).join(small(parts), "word")
    if longest == 1:
        return met.select(key, "pos", (F.col("pos") + 1).alias("end"), F.col("word").alias("phrase")).join(small(known), "phrase")
    order = Window.partitionBy(key).orderBy("pos")
    runs = spread(met, key).withColumns({f"_{n}": F.when(F.lead("pos", n).over(order) == F.col("pos") + n, F.lead("word", n).over(order)) for n in range(1, longest)})
    said = [F.struct(F.lit(1).alias("n"), F.col("word").alias("phrase"))]
    said += [F.when(F.col(f"_{n}").isNotNull(), F.struct(F.lit(n + 1).alias("n"), F.concat_ws(" ", "word", *[F.col(f"_{i}") for i in range(1, n + 1)]).alias("phrase"))) for n in range(1, longest)]
    found = runs.select(key, "pos", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("x"))
    return found.select(key, "pos", (F.col("pos") + F.col("x.n")).alias("end"), "x.phrase").join(small(known), "phrase")


def with_a_word(docs: DataFrame, dictionary: DataFrame, text: str = "text", most: int = 64) -> DataFrame:
    """The rows whose text has one of the words of a dictionary's phrases as a part, where these are at most ``most``; else all.

    No other row has a phrase; a search for parts is cheaper than all words of a text.
    """
    parts = dictionary.select(F.explode(F.split(F.lower("phrase"), " ")).alias("word")).distinct()
    found = [r.word for r in parts.limit(most + 1).collect()]
    return lowered(docs, text).where(gates.has(F.col("_low"), *found)).select(*docs.columns) if len(found) <= most else docs


def tag_keywords(docs: DataFrame, dictionary: DataFrame, longest: int | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, end, type, norm): dictionary phrases (phrase, type, norm), left to right, the longest first, without overlap.

    Phrases of over ``longest`` words are left out; without it, none are.
    """
    # of equal phrases the first by type and norm stays, as they match at the same places
    known = dictionary.groupBy(F.lower("phrase").alias("phrase")).agg(F.min(F.struct("type", "norm")).alias("_x")).select("phrase", "_x.type", "_x.norm")
    longest = longest_phrase(known) if longest is None else longest
    # a phrase has as many rows as places: a shuffle by phrases would bring all of a common one into one task
    found = phrase_matches(docs, known, longest, key, text).join(small(known), "phrase")
    if longest == 1:  # matches of one word don't overlap
        return found.select(key, "pos", "end", "type", "norm")
    # matches that overlap form a cluster; within it one stays if it begins where the last one that stayed has ended
    before = Window.partitionBy(key).orderBy("pos", F.col("end").desc(), "type", "norm")
    free = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_new", F.when(F.col("pos") < free, 0).otherwise(1)).withColumn("_c", F.sum("_new").over(before))
    ordered = found.groupBy(key, "_c").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("end")).alias("less"), "end", "type", "norm"))).alias("m"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("kept"))
    places = F.sequence(F.lit(0), F.size("m") - 1)
    walk = F.aggregate(places, start, lambda a, i: F.when(F.get("m", i)["pos"] >= a["free"], F.struct(F.get("m", i)["end"].alias("free"), F.array_append(a["kept"], i).alias("kept"))).otherwise(a), lambda a: a["kept"])
    alone = F.when(F.size("m") == 1, F.array(F.lit(0))).otherwise(walk)
    chosen = ordered.withColumn("at", alone).select(key, "m", F.explode("at").alias("i"))
    return chosen.select(key, F.get("m", F.col("i")).alias("x")).select(key, "x.pos", "x.end", "x.type", "x.norm")


#: Kinds of typed spans and their patterns (whole match). Of kinds that match at one place the longer comes first, so the first to match is the longest.
SPANS = (
    ("percent", r"\b\d+(?:\.\d+)?\s?%"),
    ("data_size", r"\b\d+(?:\.\d+)?\s?(?i:kb|mb|gb|tb)\b"),
    ("date", r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}[- ]?(?:[Jj]an|[Ff]eb|[Mm]ar|[Aa]pr|[Mm]ay|[Jj]un|[Jj]ul|[Aa]ug|[Ss]ep|[Oo]ct|[Nn]ov|[Dd]ec)[a-z]*[- ]?\d{2,4})\b"),
    ("time", r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AaPp][Mm])?\b"),
    ("amount", r"(?:\b(?i:rs\.?|inr|usd)|[₹$€£])\s*\d[\d,]*(?:\.\d+)?(?:\s*(?i:lakhs?|lacs?|k|crores?)\b)?"),
    ("account", r"(?<![A-Za-z0-9])[xX*]{2,}\d{3,6}\b"),
    ("ussd", r"\*\d{2,4}(?:\*\d+)*#"),
    ("phone", r"(?<!\d)(?:\+\d{1,3}[ -]?)?[6-9]\d{9}(?!\d)"),
    ("number", r"(?<![\p{L}\d.,*#:/-])\d[\d,]*(?:\.\d+)?(?![\p{L}\d%*#:/-])(?!\s?(?:[kmgtKMGT][bB]\b|%))"),
)
MULTIPLES = (("crore", 10_000_000), ("lakh", 100_000), ("lac", 100_000), ("k", 1_000))
# Marks that the scan sets around spans; as characters of a text they are blanks.
_OPEN, _NEXT, _CLOSE = "\x01", "\x02", "\x03"


def typed_spans(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, end, word, word_end, kind, n, raw, value): all spans of a text, left to right, the longest first, without overlap.

    One scan with all patterns marks the spans; their places are running sums over what stands between marks. ``pos`` and
    ``end`` count characters from 0, ``word`` and ``word_end`` words as ``tokens`` numbers them; n is the span's number of its
    kind, from 0; amounts, numbers and percents have a value. Texts without a digit are not scanned.
    """
    either = "|".join(f"({p})" for _, p in SPANS)
    marks = _OPEN + _NEXT.join(f"${i}" for i in range(1, len(SPANS) + 1)) + _CLOSE
    marked = F.regexp_replace(F.translate(text, _OPEN + _NEXT + _CLOSE, "   "), either, marks)
    parts = docs.where(F.col(text).rlike(r"\d")).select(key, F.posexplode_outer(F.split(marked, _OPEN)).alias("i", "part"))
    # a part is a span (none in the first) and the text up to the next
    inner = F.split(F.substring_index("part", _CLOSE, 1), _NEXT)
    first = F.col("i") == 0
    raw = F.when(first, "").otherwise(F.array_join(inner, ""))
    parts = parts.select(key, "i", raw.alias("raw"), F.when(first, F.col("part")).otherwise(F.substring_index("part", _CLOSE, -1)).alias("rest"), F.when(~first, F.element_at(F.array(*[F.lit(k) for k, _ in SPANS]), F.array_position(F.transform(inner, lambda x: x != ""), True).cast("int"))).alias("kind"))
    order = Window.partitionBy(key).orderBy("i")
    word, whole = r"[\p{L}\p{N}]", F.concat("raw", "rest")
    # a word that a mark cuts counts once
    parts = parts.withColumn("cut", (F.lag(whole).over(order).rlike(word + "$") & F.col("raw").rlike("^" + word)).cast("int"))
    sums = {"pos": F.length(whole), "word": F.regexp_count(whole, F.lit(WORD))}
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "kind", "raw", "i", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int").alias(k) for k, c in sums.items()], F.coalesce(F.sum("cut").over(order), F.lit(0)).cast("int").alias("cuts"))
    found = parts.where("kind IS NOT NULL").withColumn("word", F.col("word") - F.col("cuts"))
    found = found.withColumn("n", (F.row_number().over(Window.partitionBy(key, "kind").orderBy("i")) - 1).cast("int"))
    value = F.when(F.col("kind").isin("amount", "number", "percent"), span_value(F.col("raw")))
    return found.select(key, "pos", (F.col("pos") + F.length("raw")).alias("end"), "word", (F.col("word") + F.regexp_count("raw", F.lit(WORD))).alias("word_end"), "kind", "n", "raw", value.alias("value"))


def span_value(raw: Column) -> Column:
    base = parse_amount(F.regexp_extract(raw, r"(\d[\d,]*(?:\.\d+)?)", 1), positive=False)
    out = base
    for word, times in reversed(MULTIPLES):
        out = F.when(F.lower(raw).rlike(rf"\d\s*{word}s?$"), base * times).otherwise(out)
    return out.cast("decimal(18,2)")


def merge_spans(typed: DataFrame, keyword: DataFrame, key: str = "id") -> DataFrame:
    """Typed spans, and the keywords that overlap none of them; both (key, pos, end, type, norm).

    A sweep over the places where typed spans begin and keywords end: a keyword is free if no typed span that has begun by
    then ends after the keyword's begin. One window, whose cost follows the number of spans in any text.
    """
    both = typed.withColumn("_typed", F.lit(1)).unionByName(keyword.withColumn("_typed", F.lit(0)))
    at = F.when(F.col("_typed") == 1, F.col("pos")).otherwise(F.col("end"))
    swept = Window.partitionBy(key).orderBy(at, "_typed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.max(F.when(F.col("_typed") == 1, F.col("end"))).over(swept)
    return spread(both, key).withColumn("_reached", reached).where((F.col("_typed") == 1) | F.col("_reached").isNull() | (F.col("_reached") <= F.col("pos"))).drop("_typed", "_reached")


def near(spans: DataFrame, rules: list[tuple[int, str, str, int, tuple[str, ...]]], key: str = "id") -> DataFrame:
    """(key, rule, a_pos, b_pos): for each text, of the first rule (id, a, b, most between, allowed types) that holds the nearest pair.

    ``spans`` are rows (key, pos, type) by token position. One pass for all rules: every row knows the nearest earlier place of
    each type that begins a rule, and the nearest earlier one of a type that a rule doesn't allow in between. If the nearest
    place doesn't do for a rule, none before it does, as whatever lies between stays there.
    """
    earlier = Window.partitionBy(key).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    last = lambda hit: F.last(F.when(hit, F.col("pos")), ignorenulls=True).over(earlier)
    begins = {a: f"_a{i}" for i, a in enumerate(dict.fromkeys(r[1] for r in rules))}
    bars = {allowed: f"_b{i}" for i, allowed in enumerate(dict.fromkeys(tuple(r[4]) for r in rules))}
    seen = spread(spans, key).select(key, "pos", "type", *[last(F.col("type") == a).alias(n) for a, n in begins.items()], *[last(~F.col("type").isin(list(x)) if x else F.lit(True)).alias(n) for x, n in bars.items()])
    pairs = []
    for number, a, b, most, allowed in rules:
        p1, bar = F.col(begins[a]), F.col(bars[tuple(allowed)])
        holds = (F.col("type") == b) & (F.col("pos") - p1 <= most + 1) & (bar.isNull() | (bar <= p1))
        pairs.append(F.when(holds, F.struct(F.lit(number).alias("rule"), (F.col("pos") - p1).alias("d"), p1.alias("p1"), F.col("pos").alias("p2"))))
    best = F.array_min(F.array(*pairs)) if len(pairs) > 1 else pairs[0]
    return seen.where(F.col("type").isin(list({r[2] for r in rules}))).select(key, best.alias("m")).where("m IS NOT NULL").groupBy(key).agg(F.min("m").alias("m")).select(key, "m.rule", F.col("m.p1").alias("a_pos"), F.col("m.p2").alias("b_pos"))


def capture_between(words: DataFrame, starts: list[str], stops: list[str], key: str = "id") -> DataFrame:
    """(key, start, captured): words after the first start word up to the next stop word, numbers left out; null captures are dropped.

    ``words`` are rows (key, pos, word). Running minima from the end of a text find each word's next stop, so a text of any
    length costs one sort; only what is captured is gathered. Without a later stop word the capture goes to the end.
    """
    after = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    marked = spread(words, key).withColumn("next_stop", F.min(F.when(F.col("word").isin(stops), F.col("pos"))).over(after))
    begins = F.min(F.when(F.col("word").isin(starts) & (F.coalesce("next_stop", F.lit(2**31 - 1)) > F.col("pos") + 1), F.struct("pos", "next_stop"))).over(Window.partitionBy(key))
    rows = marked.withColumn("b", begins).where("b IS NOT NULL AND pos > b.pos AND (b.next_stop IS NULL OR pos < b.next_stop)").where(~F.col("word").rlike(r"^\d+$"))
    return rows.groupBy(key, F.col("b.pos").alias("start")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("captured"))


_MONTHS = {m: f"{i:02}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Day, month and year as numbers; day, name of a month and year; the name first.
_NUMBERS, _NAMED, _NAME_FIRST = r"^0*(\d{1,2})([-/])0*(\d{1,2})\2(\d{4})$", r"^0*(\d{1,2})([- ]?)([A-Za-z]{3})\2(\d{4})$", r"^([A-Za-z]{3}) 0*(\d{1,2}) (\d{4})$"


def normal_date(raw: Column, context: Column) -> Column:
    """DATE of a date text: day first, month names, two-digit years (under 70: 20yy), swapped if the month is over 12, year from ``context`` if missing; 1970 to 2099.

    Every step's text is made once. Its form is told by a pattern, and turned into year-month-day, which a cast reads: no form is
    tried that doesn't fit, as each that fails would cost an exception.
    """
    short = r"^(\d{1,2}[-/ ]?(?:\d{1,2}|[A-Za-z]{3})[-/ ]?)(\d{2})$"

    def full_year(c: Column) -> Column:
        whole = F.concat(F.regexp_extract(c, short, 1), F.when(F.right(c, F.lit(2)).try_cast("int") < 70, F.lit("20")).otherwise(F.lit("19")), F.right(c, F.lit(2)))
        return F.when(c.rlike(r"^\d{1,2}[-/ ]?(?:\d{1,2}[-/ ]|[A-Za-z]{3}[-/ ]?)\d{2}$"), whole).otherwise(c)

    def with_year(c: Column) -> Column:
        return F.when(c.rlike(r"^\d{1,2}[- ]?[A-Za-z]{3}$"), F.concat(F.regexp_replace(c, r"^(\d{1,2})[- ]?([A-Za-z]{3})$", "$1-$2-"), F.year(context).cast("string"))).otherwise(c)

    def named(c: Column, pattern: str, day: str, month: int, year: str) -> Column:
        number = F.try_element_at(F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair]), F.lower(F.regexp_extract(c, pattern, month)))
        return F.concat(F.regexp_replace(c, pattern, year), F.lit("-"), number, F.lit("-"), F.regexp_replace(c, pattern, day)).try_cast("date")

    def read(c: Column) -> Column:
        numbers = F.coalesce(F.regexp_replace(c, _NUMBERS, "$4-$3-$1").try_cast("date"), F.regexp_replace(c, r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$", "$4-$1-$3").try_cast("date"))
        return (
            F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")).when(c.rlike(_NUMBERS), numbers)
            .when(c.rlike(_NAMED), named(c, _NAMED, "$1", 3, "$4")).when(c.rlike(_NAME_FIRST), named(c, _NAME_FIRST, "$2", 1, "$3"))
        )

    plain = F.initcap(F.trim(F.translate(raw, ".,", "  ")))
    c = let(F.regexp_replace(plain, r"^(\d{1,2})(?:st|nd|rd|th|St|Nd|Rd|Th)\b", "$1"), full_year)
    return let(let(let(c, with_year), read), lambda day: F.when(F.year(day).between(1970, 2099), day))


def fallback_amount(spans: DataFrame, messages: DataFrame, key: str = "msg_id", body: str = "body") -> DataFrame:
    """(key, amount, balance) where no pattern paired an amount: the first amount span that isn't the balance; in balance-only notices the first is the balance.

    ``spans`` as of ``typed_spans``; an amount before "is", "was" or "has been" and a verb is no balance.
    """
    from . import fields, gates

    amounts = spans.where("kind = 'amount'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "value")))["value"].alias("values"))
    rows = messages.select(key, fields.direction(F.col(body)).alias("type"), fields.balance(F.col(body)).alias("bal"), gates.is_balance_notice(F.col(body)).alias("only")).join(amounts, key, "left")
    unpaired = F.filter("values", lambda v: F.col("bal").isNull() | (v != F.col("bal")))
    return rows.select(key, F.when(F.col("type").isNotNull(), F.get(unpaired, F.lit(0))).alias("amount"), F.when(F.col("only"), F.coalesce("bal", F.get("values", F.lit(0)))).otherwise(F.col("bal")).alias("balance"))
