"""Toxicity by averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams of 3 to 5 letters between marks of its ends, each a vector of a hashed table; so unseen
misspellings and forms share the vectors of those that the labelled texts have. A passage of a few words is the mean of its words (a repeated one counts once), and a softmax layer over two
classes judges passages (of two, the difference of both rows is the layer): a text of any length is as toxic as its most toxic passage, so length doesn't thin out what it
says. A label names no passage, so in training a text's passages share its error by how toxic they look so far, which goes from all alike
to the worst ones. A fifth of the learning rows are kept from the training and calibrate the score.

Words are what white space parts, without all but letters and digits, lower-cased, cut at ``LONGEST`` letters. At most
``ROWS`` learning rows a class, by the hash of their id, of at most ``BYTES`` bytes of text, train the model; counts, scores and verdicts cover all rows and whole texts.

Defined results: null, empty and wordless texts score the share of toxic texts among the learning rows; without learning rows of both classes that have words all rows score that share (0 without any);
rows with a null id or label teach nothing; of several labels of an id the highest counts; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import hash_sample, session

#: Learning rows of each class, at most, and bytes of the text of one.
ROWS, BYTES = 3_000, 1 << 14
BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 16, (3, 4, 5)
PASSAGE, LONGEST = 5, 32
EPOCHS, RATE, DECAY, SEED = 80, 0.3, 1e-4, 20240607
#: How sharply a text's error goes to its worst passages; the floor of a row's step size, by the largest gradient; texts that an n-gram with a vector has at least.
SHARP, FLOOR, FEWEST = 2.0, 0.3, 5
#: Of the learning rows, one in so many calibrates.
KEPT = 5
TOXIC = 0.7
U64 = np.uint64
_tables: list[np.ndarray] = []


def _points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 2 if it is white space, 1 if a letter, mark or digit, else 0; and its lower case."""
    if not _tables:
        kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x30000):  # planes beyond have private and rare signs, which count as letters
            c = chr(i)
            kind[i] = 2 if c.isspace() else c.isalnum()
            if kind[i] and len(x := c.lower()) == 1:
                lower[i] = ord(x)
        kind[0x30000:] = 1
        _tables[:] = [kind, lower]
    return _tables[0], _tables[1]


@dataclass
class Words:
    """Words of a run of texts, one after another between marks: buckets of the n-grams that begin at each place (one past the table: none), each word's first place, number of n-grams and hash, and each text's first word."""

    grams: list[np.ndarray]
    begins: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    kind, lower = _points()
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ahead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
    own = kind[points]
    kept = own == 1
    text = np.zeros(len(points), np.int64)
    opens = ahead[offsets[1:-1]]
    np.add.at(text, opens[opens < len(points)], 1)
    word = (np.cumsum(own == 2) + np.cumsum(text))[kept]  # differs from word to word
    letters, text = lower[points[kept]], np.cumsum(text)[kept]
    if not len(letters):
        return Words([np.zeros(0, np.int32) for _ in GRAMS], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    first = np.append(True, word[1:] != word[:-1])
    starts = np.flatnonzero(first)
    place = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    first |= (place > 0) & (place % LONGEST == 0)
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(letters)))
    begins = starts + 2 * np.arange(len(starts))
    marked = np.full(len(letters) + 2 * len(starts), 1, U64)
    marked[np.arange(len(letters)) + 2 * np.cumsum(first) - 1] = letters
    marked[begins + lengths + 1] = 2
    end = np.repeat(begins + lengths + 2, lengths + 2)
    at = np.arange(len(marked))
    grams, code = [], marked.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[: len(marked) - n + 1] * U64(H.BASE) + marked[n - 1 :]
        if n in GRAMS:
            bucket = np.full(len(marked), BUCKETS, np.int32)
            bucket[: len(code)] = (H.mix(code + U64(n)) >> U64(64 - 18)).astype(np.int32)
            bucket[at + n > end] = BUCKETS
            grams.append(bucket)
    counts = sum(np.maximum(lengths + 3 - n, 0) for n in GRAMS)
    hashes = np.add.reduceat(H.mix(marked + (at - np.repeat(begins, lengths + 2)).astype(U64) * U64(H.BASE)), begins)
    return Words(grams, begins, counts, hashes, np.searchsorted(text[starts], np.arange(len(offsets))))


def passages(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the passages, and each text's first passage, from its first word. A rest joins the passage before it."""
    words = np.diff(texts)
    n = np.where(words > 0, np.maximum(words // PASSAGE, 1), 0)
    first = np.append(0, np.cumsum(n))
    within = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.repeat(texts[:-1], n) + within * PASSAGE, first


def shares(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's passage and its part of the mean: a word that its passage has had counts nothing, and a passage has ``PASSAGE`` places at least."""
    size = np.diff(np.append(begins, len(hashes)))
    passage = np.repeat(np.arange(len(begins)), size)
    part = (1 / np.maximum(size, PASSAGE))[passage]
    for back in range(1, 2 * PASSAGE - 1):
        part[back:][(hashes[back:] == hashes[:-back]) & (passage[back:] == passage[:-back])] = 0
    return passage, part


@dataclass
class Model:
    """What an n-gram adds to the log-odds (its vector times the layer's), the offset, and the calibration."""

    grams: np.ndarray
    offset: float
    slope: float
    shift: float
    share: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.share)
        if not len(self.grams):
            return out
        w = words_of(data, offsets)
        if not len(w.begins):
            return out
        word = np.add.reduceat(sum(self.grams[g] for g in w.grams), w.begins) / w.counts
        begins, first = passages(w.texts)
        odds = np.add.reduceat(word * shares(w.hashes, begins)[1], begins) + self.offset
        full = np.flatnonzero(np.diff(first))
        worst = np.maximum.reduceat(odds, first[full])
        out[full] = 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -50, 50)))
        return out


def train(texts: list[str], labels: np.ndarray, kept: np.ndarray, share: float) -> Model:
    """The model of labelled texts; those ``kept`` only calibrate it and say when to stop."""
    tokens, first_words, flat, of, counts, seen = [], [0], [], [], [], np.zeros(0, U64)
    for _, data, offsets in H.slices(pa.array(texts, pa.string())):
        w = words_of(data, offsets)
        tokens.append(w.hashes)
        first_words.extend(first_words[-1] + w.texts[1:])
        # equal words have equal bags: those of distinct words are enough
        new, one = np.unique(w.hashes, return_index=True)
        fresh = ~np.isin(new, seen)
        new, one = new[fresh], one[fresh]
        number = np.full(len(w.begins), -1)
        number[one] = len(seen) + np.arange(len(one))
        for g in w.grams:
            owner = np.repeat(number, np.diff(np.append(w.begins, len(g))))
            own = (g < BUCKETS) & (owner >= 0)
            flat.append(g[own])
            of.append(owner[own])
        counts.append(w.counts[one])
        seen = np.append(seen, new)
    flat, of, counts, tokens = (np.concatenate(x) for x in (flat, of, counts, tokens))
    order = np.argsort(seen)
    word = order[np.searchsorted(seen[order], tokens)]
    starts = np.asarray(first_words)
    begins, first = passages(starts)
    passage, part = shares(tokens, begins)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    # n-grams of few texts teach nothing: they have no vector
    texts_of = np.bincount(np.unique(np.repeat(np.arange(len(texts)), np.diff(starts)) * len(seen) + word) % len(seen), minlength=len(seen))
    known = np.bincount(flat, texts_of[of], BUCKETS) >= FEWEST
    flat, of = flat[known[flat]], of[known[flat]]
    fine = np.diff(first) > 0
    if len(np.unique(labels[fine])) < 2:
        return Model(np.zeros(0, np.float32), 0.0, 1.0, 0.0, share)
    learns = ~kept
    if len(np.unique(labels[kept & fine])) < 2:  # too few rows to keep some
        kept = np.ones(len(texts), bool)
    weight = np.where(labels == 1, 0.5 / max(1, (labels[learns] == 1).sum()), 0.5 / max(1, (labels[learns] == 0).sum())) * learns
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, offset = rng.normal(0, 0.3, DIMENSIONS).astype(np.float32), 0.0
    spent = None
    best: tuple[float, np.ndarray, float, float, float] | None = None
    for epoch in range(EPOCHS):
        value = vectors @ layer
        odds = np.bincount(passage, (np.bincount(of, value[flat], len(seen)) / counts)[word] * part, len(begins)) + offset
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, odds)
        if epoch % 5 == 4:
            slope, shift, loss = calibrated(top[kept & fine], labels[kept & fine])
            if best is None or loss < best[0]:
                best = (loss, value.copy(), offset, slope, shift)
        look = np.exp(SHARP * (odds - top[doc]))
        look /= np.bincount(doc, look, len(texts))[doc]
        error = (1 / (1 + np.exp(-np.bincount(doc, look * odds, len(texts)))) - labels) * weight
        back = error[doc] * look
        g = np.bincount(flat, (np.bincount(word, back[passage] * part, len(seen)) / counts)[of], BUCKETS)
        # steps follow the gradient, so what many texts share moves far and what few have stays
        g_layer = vectors.T @ g
        size = max(np.abs(g).max() * np.sqrt((layer**2).sum()), 1e-12)
        spent = np.full(BUCKETS, (FLOOR * size) ** 2) if spent is None else spent
        spent += g**2 * (layer**2).sum()
        vectors -= ((RATE / np.sqrt(spent)) * g)[:, None].astype(np.float32) * layer + np.float32(DECAY) * vectors
        layer -= (RATE / size * 0.1 * g_layer).astype(np.float32)
        offset -= RATE / size * 0.1 * back.sum()
    return Model(np.append(best[1], 0).astype(np.float32), best[2], best[3], best[4], share)


def calibrated(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Slope and shift of a logistic curve over the log-odds, by Newton's method, and its mean loss."""
    mean, scale = odds.mean(), odds.std() + 1e-9
    x = np.stack([(odds - mean) / scale, np.ones(len(odds))])
    b = np.zeros(2)
    # as many virtual rows of the other label as keep the curve finite where the classes part
    target = np.where(labels == 1, ((labels == 1).sum() + 1) / ((labels == 1).sum() + 2), 1 / ((labels == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(b @ x, -30, 30))), 1e-9, 1 - 1e-9)
    return b[0] / scale, b[1] - b[0] * mean / scale, float(-(target * np.log(p) + (1 - target) * np.log(1 - p)).mean())


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS, most_bytes: int = BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of a bounded sample, and the share of toxic ones among all labels to learn from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    drawn = hash_sample(known.where("y = 1"), rows, "id").unionAll(hash_sample(known.where("y = 0"), rows, "id"))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.octet_length("text") <= most_bytes) & (F.trim("text") != "")).join(F.broadcast(drawn), "id")  # twice ``rows`` ids
    picked = sorted(hash_sample(found, 2 * rows, "id", "text").collect(), key=lambda r: (r.id, r.text))
    return [r.text for r in picked], np.array([r.y for r in picked], np.int64), share


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: its id's crc32 leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    texts, y, share = learning_rows(docs, labels, **options)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(0, np.float32), 0.0, 1.0, 0.0, share)
    kept = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        kept[np.random.default_rng(SEED).permutation(own)[::KEPT]] = True
    return train(texts, y, kept, share)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in H.slices(batch.column(1)):
            rows = batch.slice(at, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(model.scores(data, offsets), pa.float64())], ["id", "held_out", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: float = TOXIC) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    session(docs)
    model = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    out = rows.mapInArrow(lambda it: _scored(it, model), f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
