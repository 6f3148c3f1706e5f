"""Naive Bayes over word n-grams: counts and priors, log-ratio scores, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.small import stored
from ..functions.text import mask_amounts, words

ONE_SIDED = 5.0


#: Words that are looked at together in a task. The commonest n-grams of a model, which go to every task.
RUN_WORDS, COMMON = 1 << 21, 1 << 20
#: Bits that tell which of the other n-grams may be in the model.
BITS = 1 << 27


def _worded(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    return docs.select(*keep, words(mask_amounts(F.col(text))).alias("w"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]]:
    """Runs of rows of about ``RUN_WORDS`` words: the rows, each word's row, the different words, each word's number among them. The words are a batch's last column."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // RUN_WORDS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
            rows = batch.slice(a, b - a)
            coded = rows.column(rows.num_columns - 1).flatten().dictionary_encode()
            yield rows, np.repeat(np.arange(b - a), lengths[a:b]), coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _grams(row: np.ndarray, ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n up to ``most``: n, where each different n-gram begins first, and of every pair of an n-gram and a row it is in the n-gram's number, the row and how often. Exact: n-grams are told apart by their words' numbers."""
    at, code = np.arange(len(ids)), ids
    for n in range(1, most + 1):
        if n > 1:
            stays = at + n - 1 < len(ids)
            at, code = at[stays], code[stays]
            stays = row[at] == row[at + n - 1]
            at, code = at[stays], code[stays] * (len(ids) + 1) + ids[at[stays] + n - 1]
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
        wide = int(row[-1]) + 1 if len(row) else 1
        pair, times = np.unique(code * wide + row[at], return_counts=True)
        yield n, at[first], pair // wide, pair % wide, times


def _hashes(known: pa.Array, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64 bits of the n-grams that begin at these places, the same in every task."""
    each = pd.util.hash_array(known.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(known) else np.zeros(0, np.uint64)
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ each[ids[at + i]]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _names(known: pa.Array, ids: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    return pc.binary_join_element_wise(*[known.take(pa.array(ids[at + i])) for i in range(n)], " ")


def _told(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for rows, row, known, ids in _runs(batches):
        for n, at, gram, own, times in _grams(row, ids, most):
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own)), _names(known, ids, at, n).take(pa.array(gram)), pa.array(times)], ["key", "gram", "n"])


def _classed(batches: Iterator[pa.RecordBatch], most: int, named: bool) -> Iterator[pa.RecordBatch]:
    for rows, row, known, ids in _runs(batches):
        y = rows.column(0).to_numpy(zero_copy_only=False)
        for n, at, gram, own, _ in _grams(row, ids, most):
            counts = [pa.array(np.bincount(gram[y[own] == c], minlength=len(at))) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([_names(known, ids, at, n) if named else pa.array(_hashes(known, ids, at, n)), *counts], ["gram", "n0", "n1"])


def ngrams(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(key, gram, n): n-grams of each text with their repeats; amounts are masked."""
    kind = docs.schema[key].dataType.simpleString()
    found = _worded(docs, [key], text).mapInArrow(lambda it: _told(it, most), f"key {kind}, gram string, n long")
    return found.groupBy(F.col("key").alias(key), "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = 3, least: int = 2, named: bool = False) -> DataFrame:
    """(gram, n0, n1): in how many labelled texts of class 0 and 1 an n-gram occurs, ``least`` at least in all.

    An n-gram is its 64-bit hash; ``named`` gives its words instead, for a report. Tasks count the n-grams of runs of texts,
    each once a text, so partial sums are all that is shuffled.
    """
    known = labels.select(key, F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    found = _worded(docs.join(known, key), ["y"], text).mapInArrow(lambda it: _classed(it, most, named), f"gram {'string' if named else 'long'}, n0 long, n1 long")
    counted = found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return counted.where(F.col("n0") + F.col("n1") >= least)


def priors(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col(label).isNotNull()).agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("d0"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("d1"))


def weights(model: DataFrame, prior: DataFrame) -> DataFrame:
    """(gram, w): log(p0 / p1) of class-conditional shares; evidence for one class alone is +-5."""
    out = model.join(F.broadcast(prior))  # one row
    ratio = F.log((F.col("n0") / F.col("d0")) / (F.col("n1") / F.col("d1")))
    return out.select("gram", F.when(F.col("n1") == 0, ONE_SIDED).when(F.col("n0") == 0, -ONE_SIDED).otherwise(ratio).alias("w"))


def _slot(gram: np.ndarray) -> np.ndarray:
    return gram.view(np.uint64) % np.uint64(BITS)


def _scored(batches: Iterator[pa.RecordBatch], most: int, common: Broadcast, bits: Broadcast | None) -> Iterator[pa.RecordBatch]:
    grams, w = common.value
    for rows, row, known, ids in _runs(batches):
        total, left = np.zeros(rows.num_rows), []
        for n, at, gram, own, times in _grams(row, ids, most):
            hashed = _hashes(known, ids, at, n)
            place = np.minimum(np.searchsorted(grams, hashed), max(0, len(grams) - 1))
            hit = grams[place] == hashed if len(grams) else np.zeros(len(at), bool)
            weight = np.where(hit, w[place], 0.0) if len(grams) else np.zeros(len(at))
            total += np.bincount(own, weight[gram] * times, rows.num_rows)
            if bits is not None:
                slot = _slot(hashed)
                maybe = ~hit & ((bits.value[slot >> np.uint64(6)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) == 1)
                kept = maybe[gram]
                left.append((own[kept], hashed[gram[kept]], times[kept]))
        # a row for what is known of each text, and one for every n-gram that is to be looked up
        own, gram, times = (np.concatenate([x, *(p[i] for p in left)]) for i, x in enumerate((np.arange(len(total)), np.arange(len(total)), np.zeros(len(total), np.int64))))
        sums = np.concatenate([total, np.zeros(len(own) - len(total))])
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own)), pa.array(gram), pa.array(times), pa.array(sums)], ["key", "gram", "n", "s"])


def _bitmap(model: DataFrame) -> np.ndarray:
    """Which of ``BITS`` slots the n-grams have: a fixed number of bits, however many there are."""
    slot = F.pmod(F.col("gram"), F.lit(BITS))
    rows = model.select(slot.cast("int").alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, s % 64)")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def score(docs: DataFrame, model: DataFrame, prior: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(key, score, class): log prior ratio and the weights of all n-grams with repeats; 0 if the score is 0 or more.

    ``model`` has hashes. Its commonest n-grams, at most ``COMMON``, go to every task; of the others a text's are shuffled and joined with the
    rest of the model, those that a bitmap tells aren't in it left out. Nothing else is: all n-grams count. The model is written and counted when this is called.
    """
    context = docs.sparkSession.sparkContext
    model = stored(model, "ngram-model")
    sizes = model.groupBy((F.col("n0") + F.col("n1")).alias("c")).count().orderBy(F.desc("c")).collect()  # different counts are few
    kept, bound = 0, None
    for r in sizes:
        if kept + r["count"] > COMMON:
            bound = r["c"]
            break
        kept += r["count"]
    often = F.col("n0") + F.col("n1") > (bound if bound is not None else 0)
    top = weights(model.where(often), prior).toArrow()
    grams, w = top.column("gram").to_numpy(), top.column("w").to_numpy()
    order = np.argsort(grams)
    common = context.broadcast((grams[order], w[order]))
    bits = None if bound is None else context.broadcast(_bitmap(model.where(~often)))
    kind = docs.schema[key].dataType.simpleString()
    hit = _worded(docs, [key], text).mapInArrow(lambda it: _scored(it, most, common, bits), f"key {kind}, gram long, n long, s double")
    if bound is not None:
        hit = hit.join(weights(model.where(~often), prior), "gram", "left").withColumn("s", F.col("s") + F.coalesce(F.col("n") * F.col("w"), F.lit(0.0)))
    hit = hit.groupBy(F.col("key").alias(key)).agg(F.sum("s").alias("s"))
    base = prior.select(F.log(F.col("d0") / F.col("d1")).alias("base"))
    out = docs.select(key).join(hit, key, "left").join(F.broadcast(base))
    total = F.round(F.coalesce("s", F.lit(0.0)) + F.col("base"), 6)
    return out.select(key, total.alias("score"), F.when(total >= 0, 0).otherwise(1).alias("class"))
