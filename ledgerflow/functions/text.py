"""Scalar functions on text columns. Unicode folding, words of a pattern and string similarity are Python over batches; all else is built in."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import IN_TYPES, OUT_TYPES
from .small import small

NON_ASCII = r"[^\x00-\x7F]"
CURRENCY_SIGNS = "₹€£¥$"
#: Strings that part the words of a merchant text, besides white space.
SEPARATORS = [" - ", "--", "//", "::", "->", "=>", "||", "*", "-", "/", ":", "|", "_", "~", "#", "+", ",", ";", ".", "@", "&", "(", ")", "[", "]", "<", ">", "=", "'", '"', "!", "?"]


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    def fold(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", x) if ord(c) < 128 or c in CURRENCY_SIGNS)

    return s.map(lambda x: None if x is None else fold(x))


def _where_needed(udf, c: Column) -> Column:
    """Python sees only the rows with a non-ASCII character."""
    return F.coalesce(udf(F.when(c.rlike(NON_ASCII), c)), c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_sms(c: Column) -> Column:
    """NFC, runs of white space as one space, trimmed."""
    return collapse(_where_needed(_nfc, c))


def fold_ascii(c: Column) -> Column:
    """NFKD without what isn't ASCII; currency signs stay."""
    return _where_needed(_ascii, c)


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of ``value``, which is computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def parse_amount(c: Column, positive: bool = True) -> Column:
    """DECIMAL(18,2) of a number text with group commas; null on junk and, if asked, on what isn't above 0."""
    n = F.translate(F.trim(c), ",", "").try_cast("decimal(18,2)")
    return F.when(n > 0, n) if positive else n


def clean_merchant(c: Column) -> Column:
    """White space, parentheses, dashes and stars at the edges."""
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    c = F.regexp_replace(c, r" *\([^)]*\) *", "")
    return F.trim(F.regexp_replace(c, r"^[-\s*]+|[-\s*]+$", ""))


def last4_contiguous(c: Column) -> Column:
    """Four digits that only non-digits follow."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})\D*$", 1), F.lit(""))


def last4_digits(c: Column, least: int = 3) -> Column:
    """The last four of all digits, if there are ``least`` of them."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= least, F.right(digits, F.lit(4)))


def last4_or_empty(c: Column) -> Column:
    return F.coalesce(F.right(F.regexp_replace(c, r"\D", ""), F.lit(4)), F.lit(""))


def merchant_key(c: Column) -> Column:
    """Lower case, without a trailing .com, .in or .co; what is no letter or digit becomes a space."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"\.(?:com|in|co)$", "")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), r"[^a-z0-9\p{L}\p{N}]+"), "")  # a-z and 0-9 are told without a look at their properties


def _grams(tokens: Column, most: int, made: Callable[[list[Column]], Column]) -> Column:
    """What ``made`` gives of all runs of 1 to ``most`` tokens. Runs come from shifted copies, not from places looked up, so the cost is linear."""

    def of_length(n: int) -> Column:
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        shifted = F.arrays_zip(*[F.slice(tokens, F.lit(i + 1), count).alias(f"w{i}") for i in range(n)])
        return F.transform(shifted, lambda x: made([x[f"w{i}"] for i in range(n)]))

    return F.concat(F.transform(tokens, lambda x: made([x])), *[of_length(n) for n in range(2, most + 1)])


def word_ngrams(tokens: Column, most: int = 3) -> Column:
    """All n-grams of 1 to ``most`` words, with repeats. Linear in the text: runs come from shifted copies, not from places looked up."""
    return _grams(tokens, most, lambda parts: F.concat_ws(" ", *parts) if len(parts) > 1 else parts[0])


def gram_hashes(tokens: Column, most: int = 3) -> Column:
    """64-bit hashes of all n-grams of 1 to ``most`` words, with repeats."""
    return _grams(tokens, most, lambda parts: F.xxhash64(*parts))


def longest_phrase(dictionary: DataFrame, phrase: str = "phrase") -> int:
    """How many words the longest phrase of a dictionary has, 1 at least."""
    return max(1, dictionary.agg(F.max(F.size(words(F.col(phrase))))).first()[0] or 1)


def _found(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    find = re.compile(pattern).findall
    for batch in batches:
        seen: set[str] = set()
        for text in batch.column(0):
            seen.update(find(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])


def distinct_found(texts: DataFrame, text: Column, pattern: str, name: str) -> DataFrame:
    """(name): the different matches of a pattern without groups in all texts. A task gives those of a batch once, so few are shuffled."""
    return texts.select(text.alias("text")).where("text IS NOT NULL").mapInArrow(lambda it: _found(it, pattern), "word string").select(F.col("word").alias(name)).distinct()


def mask_amounts(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(?=[riu₹$€£\d])(?:\b(?:rs|inr|usd)\.?\s*|[₹$€£])?\b\d[\d,]*(?:\.\d+)?\b", "AMT")


def split_merchant(c: Column) -> Column:
    """Tokens between separators (the longest first) and spaces, lower-cased."""
    either = "|".join(re.escape(s) for s in sorted(SEPARATORS, key=len, reverse=True))
    return F.filter(F.split(F.lower(c), rf"(?:{either}|\s)+"), lambda w: w != "")


def direction_of(kind: Column) -> Column:
    return F.when(kind.isin(*OUT_TYPES), "out").when(kind.isin(*IN_TYPES), "in").otherwise("none")


def lcs(a: str, b: str) -> int:
    """Length of the longest common substring."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro-Winkler similarity; half transpositions count, the prefix bonus needs a Jaro of 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    left, at, free = [], [], b
    for i, x in enumerate(a):
        j = free.find(x, max(0, i - reach), i + reach + 1)
        if j >= 0:
            left.append(x)
            at.append(j)
            free = free[:j] + "\ud800" + free[j + 1 :]  # a half of a pair: no text has it alone
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in sorted(at)]
    t = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro) if jaro >= 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# or Spark would move a filter on it below a distinct, and score every repeat, and what is left once more
jaro_winkler_col = jaro_winkler_col.asNondeterministic()


@F.pandas_udf(T.IntegerType())
def lcs_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _runs(c: Column, n: Column | int) -> Column:
    """All different substrings of ``n`` characters."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str, size: int = 3) -> DataFrame:
    """The rows of ``texts`` joined with those of ``parts`` that they contain, as substrings; empty parts and nulls match nothing.

    An inverted index: a part is listed under its rarest run of ``size`` characters (a shorter one under itself), a text looks up
    all its runs, and what it meets is checked. The join is one of equality: an index of few bytes is broadcast, so that runs of
    texts stay where they are, a larger one is joined by shuffle.
    """
    kept = parts.where(F.length(part) > 0)
    each = kept.select(part, F.least(F.length(part), F.lit(size)).alias("_n")).distinct()
    runs = each.select(part, "_n", F.explode_outer(_runs(F.col(part), F.col("_n"))).alias("_run"))
    counts = runs.groupBy("_run").agg(F.count("*").alias("_c"))
    index = runs.join(counts, "_run").groupBy(part).agg(F.min(F.struct("_c", "_run"))["_run"].alias("_run"))
    lengths = sorted(r[0] for r in each.select("_n").distinct().collect())  # up to ``size``
    if not lengths:
        return texts.join(kept, F.lit(False))
    looked = texts.select(text).distinct().select(text, F.explode_outer(F.array_distinct(F.concat(*[_runs(F.col(text), n) for n in lengths]))).alias("_run"))
    met = looked.join(small(index), "_run").where(F.contains(text, part)).select(text, part)
    return texts.join(met, text).join(kept, part)


class Parts:
    """Which of some parts a text contains first, by an index of rare runs of bytes, for batches of texts in a task.

    As in ``containing``, a part is listed under its rarest run of ``SIZE`` bytes (a shorter one under itself); all runs of a
    batch are looked up at once, and what is met is checked.
    """

    SIZE, BITS = 4, 20

    def __init__(self, parts: list[str]) -> None:
        self.parts = [p.encode() for p in parts]
        runs = [{p[i : i + self.SIZE] for i in range(max(1, len(p) - self.SIZE + 1))} for p in self.parts]
        counts = Counter(r for each in runs for r in each)
        listed: dict[int, dict[int, list[int]]] = {}
        for i, each in enumerate(runs):
            if self.parts[i]:  # an empty part is contained in nothing
                run = min(each, key=lambda r: (counts[r], r))
                listed.setdefault(len(run), {}).setdefault(int.from_bytes(run, "little"), []).append(i)
        self.index = {}
        for n, under in listed.items():
            codes = np.array(sorted(under), np.uint32)
            slots = np.zeros(1 << self.BITS, bool)
            slots[self._slot(codes)] = True
            self.index[n] = slots, codes, [under[int(c)] for c in codes]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def first(self, texts: pa.Array) -> np.ndarray:
        """The number of the first of the parts that each text contains, -1 for none and for null."""
        none = len(self.parts)
        out = np.full(len(texts), none, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        if not len(texts) or data is None:
            return np.full(len(texts), -1, np.int64)
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends, whole = ends - ends[0], held.tobytes()
        for n, (slots, codes, under) in self.index.items():
            if len(held) < n:
                continue
            code = np.zeros(len(held) - n + 1, np.uint32)
            for i in range(n):
                code |= held[i : len(held) - n + 1 + i].astype(np.uint32) << np.uint32(8 * i)
            at = np.flatnonzero(slots[self._slot(code)])
            place = np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)
            text = np.searchsorted(ends, at, "right") - 1
            met = (codes[place] == code[at]) & (at + n <= ends[text + 1])
            for pair in np.unique(text[met] * len(codes) + place[met]).tolist():
                i, run = divmod(pair, len(codes))
                body = whole[ends[i] : ends[i + 1]]
                for part in under[run]:
                    if part >= out[i]:
                        break
                    if self.parts[part] in body:
                        out[i] = part
        return np.where(out == none, -1, out)


#: How many marks at once two words are found by, and up to how many characters the longer word may then have besides those in common; beyond, by one.
TOGETHER = ((3, 4), (2, 8))
#: Bytes up to which the index of words is broadcast.
INDEX_BYTES = 64 << 20


def _needed(la: int, lb: int, gate: int, begin: int) -> int:
    """How many characters words of these lengths have in common at least, if they begin with ``begin`` common ones and are over the gate."""
    return max(1, (3 * gate - 20 * begin - 100) * la * lb // ((100 - 10 * begin) * (la + lb)) + 1)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each row in order, and how often each has come before in its row."""
    x = np.sort(x, axis=1)
    at = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    new = np.ones(x.shape, bool)
    new[:, 1:] = x[:, 1:] != x[:, :-1]
    return x, at - np.maximum.accumulate(np.where(new, at, 0), axis=1)


def _marks(chars: np.ndarray) -> np.ndarray:
    """The characters of words of one length, each with how often it has come before, as numbers: repeated and late letters, which are rare, first."""
    x, nth = _numbered(chars)
    return np.sort(((1 << 30) - nth.astype(np.int64)) * 2**21 + (0x10FFFF - x), axis=1).astype(np.uint64)


def _letters(chars: np.ndarray) -> np.ndarray:
    """64 bits of each word: which of 32 slots of characters come once or more, and which twice or more."""
    slot, nth = _numbered(chars & 31)
    bits = np.where(nth < 2, np.uint64(1) << (slot + 32 * np.minimum(nth, 1)).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1, initial=np.uint64(0)).astype(np.int64)


def _mixed(seed: int | np.ndarray, x: np.ndarray) -> np.ndarray:
    x = (np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64) if isinstance(seed, int) else seed * np.uint64(0x9E3779B97F4A7C15)) + x
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _word_keys(chars: np.ndarray, others: Iterable[int], gate: int, left: bool) -> np.ndarray:
    """The keys that words of one length, a row each, are found by among words of the lengths ``others``."""
    n, own = chars.shape
    first = chars.astype(np.uint64)
    keys = [_mixed(_mixed(2, first[:, 0]), first[:, 1])] if own > 1 else []
    for begin in (0, 1):
        marks = _marks(chars[:, begin:])
        for other in others:
            need = _needed(own, other, gate, begin)
            if need > min(own, other):
                continue
            more = max(own, other) - need
            k = min(next((k for k, most in TOGETHER if more <= most), 1), need - begin)
            a, b = (own, other) if left else (other, own)
            seed = _mixed((a << 34) + (b << 4) + begin + 3, first[:, 0] if begin else np.zeros(n, np.uint64))
            for places in itertools.combinations(range(own - need + k), k):
                key = seed
                for i in places:
                    key = _mixed(key, marks[:, i])
                keys.append(key)
    return np.stack(keys, axis=1) if keys else np.zeros((n, 0), np.uint64)


def _listed(batches: Iterator[pa.RecordBatch], lengths: list[int] | None, gate: int) -> Iterator[pa.RecordBatch]:
    """Words with their lengths, letters and keys; against words of ``lengths``, or (for the index) of any."""
    widest = min((3 * gate - 20 * b - 100) / (100 - 10 * b) for b in (0, 1)) - 1  # lengths differ by no larger a factor than 1 / widest
    for batch in batches:
        groups: dict[int, list[str]] = {}
        for w in batch.column(0).to_pylist():
            groups.setdefault(len(w), []).append(w)
        for size, words in groups.items():
            chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)
            others = [x for x in lengths if size * widest <= x <= size / widest] if lengths is not None else range(max(1, int(size * widest)), int(size / widest) + 2)
            step = max(1, (1 << 21) // size)
            for i in range(0, len(words), step):
                keys = _word_keys(chars[i : i + step], others, gate, lengths is not None)
                ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + step], pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(_letters(chars[i : i + step])), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.astype(np.int64).ravel()))], ["word", "n", "letters", "keys"])


def similar_candidates(left: DataFrame, right: DataFrame, gate: int = 90) -> DataFrame:
    """(a, b): all pairs of words of ``left`` (a) and ``right`` (b) whose Jaro-Winkler similarity can be over ``gate`` hundredths, which is over 70.

    No pair over the gate is lost: similarity bounds the matches from below, by the lengths and the common beginning, and
    matches are at most the characters that both have. So of words of given lengths that have no more than the first character
    in common at their beginning, some k of the first few marks (the rarest) of both must be the same; others are found by their
    first two characters. That is a join of equality with the words of ``right``, whose index is broadcast if it is small. Then the lengths, the beginning
    and the letters are looked at. Only the different lengths of the words of ``right`` are collected.
    """
    if gate <= 70:
        raise ValueError("the gate has to be over 70")

    def listed(words: DataFrame, name: str, lengths: list[int] | None) -> DataFrame:
        rows = words.select(name).where(F.length(name) > 0).distinct().mapInArrow(lambda it: _listed(it, lengths, gate), "word string, n int, letters long, keys array<long>")
        return rows.select(F.col("word").alias(name), F.col("n").alias(f"_l{name}"), F.col("letters").alias(f"_s{name}"), F.explode("keys").alias("_key"))

    lengths = sorted(r[0] for r in right.select(F.length("b")).where(F.length("b") > 0).distinct().collect())
    met = listed(left, "a", lengths).join(small(listed(right, "b", None), INDEX_BYTES), "_key")
    begin = F.lit(0)
    for n in (1, 2, 3, 4):
        begin = F.when((F.substring("a", 1, n) == F.substring("b", 1, n)) & (F.least("_la", "_lb") >= n), n).otherwise(begin)
    other = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    common = F.least(F.col("_la") - other("_sa", "_sb"), F.col("_lb") - other("_sb", "_sa"))
    enough = lambda begin: common * (F.col("_la") + F.col("_lb")) * (100 - 10 * begin) > (3 * gate - 20 * begin - 100) * F.col("_la") * F.col("_lb")
    return met.where(enough(F.lit(4))).where(enough(begin)).select("a", "b").distinct()
