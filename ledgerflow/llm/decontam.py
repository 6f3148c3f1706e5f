"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's k-gram hashes are thinned to the smallest of every w consecutive ones. Two texts that share a span of
w + k - 1 words share all hashes of it and so its smallest one: with w + k - 1 = ``window`` no shared window is missed.
Fingerprints of documents and items are joined on their hash alone; hits are then extended to all windows around
them, and a window counts only if its words are equal.

An item with fewer words than ``window`` is one window of its own length, for which k and w shrink.

Defined results: null and empty texts have no words and no hits; items without words have no window; repeated items
with one id count once; null item ids are not named; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, session, written

WINDOW, GRAM = 10, 5
#: Word characters are all but these, each named alone: Java's regexes look single characters up in a table, ranges not.
_NO_LETTER = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
ANY_WORD = "[^" + "".join(f"\\x{c:02X}" for c in _NO_LETTER) + "]+"
#: The same after A-Z lower-casing.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in [*_NO_LETTER, *range(0x41, 0x5B)]) + "]+"
#: Bytes of benchmark fingerprints or windows up to which they are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _shape(length: int, gram: int) -> tuple[int, int]:
    """k and w for windows of ``length`` words."""
    k = min(gram, length)
    return k, length - k + 1


def _hashes(k: int) -> Column:
    """The hashes of all k-grams of ``folded``, the hashes of single words."""
    return F.when(F.size("folded") >= k, F.transform(F.sequence(F.lit(1), F.size("folded") - k + 1), lambda i: F.xxhash64(F.slice("folded", i, k))))


def _folded(words: Column) -> Column:
    """Hashes of words without case: equal for words that are equal after A-Z lower-casing, at times for more."""
    return F.transform(words, lambda x: F.xxhash64(F.lower(x)))


def _winnowed(hashes: str, w: int) -> Column:
    """The smallest of every w hashes, each once. (The column is named twice, so that it stays one of its own.)"""
    if w == 1:
        return F.array_distinct(hashes)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(hashes) - w + 1), lambda i: F.array_min(F.slice(hashes, i, w))))


def _bounded(df: DataFrame, size: Column) -> DataFrame:
    """Marked for broadcast if the bytes of its rows, as ``size`` tells, are few enough."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _hits(rows: DataFrame, spans: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(id, tag, length, start, items): each benchmark window that a text has, for windows of all lengths in one pass."""
    shapes = {length: _shape(length, gram) for length in lengths}
    hashed = {f"hashes{k}": _hashes(k) for k, _ in shapes.values()}
    # an item's fingerprints: one for each of its windows
    marks = spans.withColumn("folded", _folded(F.split("span", " "))).withColumns(hashed)
    mark = F.coalesce(*[F.when(F.col("length") == n, F.array_min(f"hashes{k}")) for n, (k, _) in shapes.items()])
    marks = written(marks.select("length", mark.alias("mark")).distinct(), "decontam-marks")
    any_words = F.regexp_extract_all("text", F.lit(ANY_WORD), F.lit(0))
    folded = _folded(any_words)
    empty = F.array().cast("array<struct<length:int,mark:bigint>>")

    def own(length: int) -> Column:
        k, w = shapes[length]
        found = F.transform(_winnowed(f"hashes{k}", w), lambda x: F.struct(F.lit(length).alias("length"), x.alias("mark")))
        return F.when(F.size("folded") >= length, found).otherwise(empty)

    texts = rows.select("id", "tag", folded.alias("folded")).withColumns(hashed)
    prints = own(lengths[0]) if len(lengths) == 1 else F.concat(*map(own, lengths))
    found = texts.select("id", "tag", F.explode(prints).alias("m")).select("id", "tag", "m.length", "m.mark").join(_bounded(marks, F.lit(40)), ["length", "mark"], "left_semi")
    found = written(found.groupBy(F.col("id").alias("fid"), F.col("tag").alias("ftag")).agg(F.collect_set(F.struct("length", "mark")).alias("marks")), "decontam-found")
    near = rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & F.col("tag").eqNullSafe(F.col("ftag")))
    near = near.select("id", "tag", "marks", words_of(F.col("text")).alias("words"), folded.alias("folded")).withColumns(hashed)

    def extended(length: int) -> Column:
        """The windows of a length that a hit can lie in."""
        k, w = shapes[length]
        hit = F.transform(F.filter("marks", lambda m: m["length"] == length), lambda m: m["mark"])
        at = F.filter(F.sequence(F.lit(1), F.size(f"hashes{k}")), lambda i: F.array_contains(hit, F.element_at(f"hashes{k}", i)))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.lit(1), p - (w - 1)), F.least(p, F.size("words") - length + 1)))))
        windows = F.transform(starts, lambda s: F.struct(F.lit(length).alias("length"), s.alias("start"), F.array_join(F.slice("words", s, length), " ").alias("span")))
        return F.when(F.size("words") >= length, windows).otherwise(F.array().cast("array<struct<length:int,start:int,span:string>>"))

    windows = near.select("id", "tag", F.explode(F.concat(*map(extended, lengths))).alias("x")).select("id", "tag", "x.*")
    size = F.octet_length("span") + F.aggregate("items", F.lit(64), lambda n, x: n + F.octet_length(x) + 16)
    return windows.join(_bounded(spans, size), ["length", "span"]).select("id", "tag", "length", "start", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, tagged: bool = False) -> DataFrame:
    """A row a row of ``docs``: id, n_words, n_hit (words in shared windows), n_items, items_sha256, contaminated; if ``tagged``, tag (the text's hash)."""
    session(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window)))
    spans = items.select("item", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda i: F.array_join(F.slice("words", i, F.col("length")), " "))).alias("span"))
    spans = written(spans.groupBy("length", "span").agg(F.collect_set("item").alias("items")), "decontam-spans")
    lengths = sorted(r[0] for r in spans.select("length").distinct().collect())  # at most ``window`` numbers
    hits = _hits(rows, spans, lengths, gram) if lengths else None
    counted = rows.select("id", "tag", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if hits is None:
        out = counted.withColumn("n_hit", F.lit(0).cast("long")).withColumn("all_items", none)
    else:
        covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
        judged = hits.groupBy(F.col("id").alias("jid"), F.col("tag").alias("jtag")).agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items"))
        out = counted.join(judged, F.col("id").eqNullSafe(F.col("jid")) & F.col("tag").eqNullSafe(F.col("jtag")), "left")
    named = F.coalesce("all_items", none)
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *(["tag"] if tagged else [])
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS span FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bn)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS span FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
h AS (SELECT doc_id, dw.l, i, item_id FROM dw JOIN bw ON dw.span = bw.span AND dw.l = bw.l),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
