"""Quality rules and an isolation forest over their statistics.

Base rules reject a text with under 10 words, or with over a fifth of its words in repeated 5-word windows. Others are
judged by an isolation forest: random splits on the statistics, where anomalies end on short paths. All labelled rows make
it: their means and variances say how often a statistic is split on (more often, if it parts the labels), each tree draws its ``LEAVES``
rows from all of them (that is the method: a tree isolates few rows), good ones and one bad one to ``CONTAMINATION`` of
them (anomalies are few), and the threshold is the score, in steps of 1 / ``STEPS``, that separates all labelled rows
best among those that turn away at most ``MOST_LOST`` of the good ones. Rows are counted by Spark; the driver sees what
the trees draw and a count a step.

Defined results: null, empty and blank texts have no words and fail the base rules; without labelled rows of both
kinds only the base rules judge; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import session, written

TREES, LEAVES = 128, 256
#: Rows that all trees draw together.
DRAWN = TREES * LEAVES
STEPS = 1 << 16
CONTAMINATION = 50
MOST_LOST = 0.005
#: A good row lost weighs as much as so many bad ones caught.
COST = 5
MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_distinct"]
_FEATURES = [f"f{i}" for i in range(7)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"!?;:=_~^@/\\\"'()[]{}+", np.uint8)] = True
_POINT = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a run of texts."""
    n = len(offsets) - 1
    words, first, _ = H.runs(data, offsets, H.SPACE)
    cut = np.searchsorted(first, offsets)
    lines, line_first, line_length = H.runs(data, offsets, H.NO_BREAK)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(H.SPACE[data], out=inside[1:])
    full = inside[line_first + line_length] > inside[line_first]
    lines, line_first = lines[full], line_first[full]
    line_cut = np.searchsorted(line_first, offsets)
    out = {k: np.zeros(n, np.int64) for k in COUNTS + MORE}
    out["n_words"], out["n_lines"] = np.diff(cut), np.diff(line_cut)
    out["word_chars"] = _per_text(H.SPACE[data] & _POINT[data], offsets)
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK)):
        out[name] = _per_text(flags[data], offsets)
    for i in range(n):
        own = words[cut[i] : cut[i + 1]]
        out["n_distinct"][i] = len(np.unique(own))
        if line_cut[i + 1] - line_cut[i] > 1:
            here = lines[line_cut[i] : line_cut[i + 1]]
            out["n_dup_lines"][i] = len(here) - len(np.unique(here))
        if len(own) > WINDOW:
            windows = H.grams(own, WINDOW)
            order = np.argsort(windows, kind="stable")
            same = windows[order[1:]] == windows[order[:-1]]
            if same.any():
                at = np.zeros(len(windows), bool)
                at[order[1:][same]] = at[order[:-1][same]] = True
                edge = np.zeros(len(own) + 1, np.int64)
                begins = np.flatnonzero(at)
                np.add.at(edge, begins, 1)
                np.add.at(edge, begins + WINDOW, -1)
                out["n_repeat_words"][i] = int((np.cumsum(edge) > 0).sum())
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in H.slices(batch.column(1)):
            found = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offsets) - 1), *(pa.array(found[k].astype(np.int64)) for k in COUNTS + MORE), *(x.slice(at, len(offsets) - 1) for x in batch.columns[2:])], ["id", *COUNTS, *MORE, *batch.schema.names[2:]])


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios, capped where more says no more; the number of words is none of them, as long and short texts are no worse."""
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([chars / words, np.minimum(c["n_symbols"] / words, 0.3), c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.minimum(c["n_upper"] / chars, 0.3), np.minimum(c["n_marks"] / words, 0.3), np.minimum(c["n_distinct"] / words, 0.5)], axis=1)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Trees as arrays of nodes, all in one: the feature a node splits on (-1: a leaf), at what, its children, its path."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, self.left[at] + (x[rows, np.maximum(f, 0)] >= self.split[at]))
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def grow(x: np.ndarray, weight: np.ndarray, seed: int = 0, trees: int = TREES, leaves: int = LEAVES) -> Forest:
    """Random splits at random places; ``weight`` is how often a statistic is drawn."""
    rng = np.random.default_rng(seed)
    leaves = min(leaves, len(x))
    deepest = math.ceil(math.log2(max(2, leaves)))
    feature, split, left, path, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (split, 0.0), (left, 0), (path, 0.0)):
            a.append(v)
        return len(feature) - 1

    enough = len(x) >= trees * leaves  # for a tree to have rows of its own
    shuffled = rng.permutation(len(x)) if enough else None
    for t in range(trees):
        roots.append(node())
        drawn = shuffled[t * leaves : (t + 1) * leaves] if enough else rng.choice(len(x), leaves, replace=False)
        todo = [(roots[-1], x[drawn], 0)]
        while todo:
            at, own, depth = todo.pop()
            low, high = own.min(0), own.max(0)
            able = np.flatnonzero(high > low)
            if depth >= deepest or len(own) < 2 or not len(able):
                path[at] = depth + float(_average_path(len(own)))
                continue
            feature[at] = f = int(rng.choice(able, p=weight[able] / weight[able].sum()))
            split[at] = float(rng.uniform(low[f], high[f])) or float(high[f])
            left[at], _ = node(), node()
            right = own[:, f] >= split[at]
            todo += [(left[at], own[~right], depth + 1), (left[at] + 1, own[right], depth + 1)]
    return Forest(np.array(roots), np.array(feature), np.array(split), np.array(left), np.array(path), float(_average_path(leaves)))


def place_threshold(forest: Forest, step: np.ndarray, good: np.ndarray, bad: np.ndarray) -> None:
    """Sets the threshold by how many good and bad rows have a score of each step (``STEPS``), or leaves it infinite."""
    order = np.argsort(-step, kind="stable")
    step, good, bad = step[order], good[order], bad[order]
    caught, lost = np.cumsum(bad) / bad.sum(), np.cumsum(good) / good.sum()
    gain = np.where(lost <= MOST_LOST, caught - COST * lost, -1.0)
    if len(gain) and gain.max() > 0:
        k = int(gain.argmax())
        below = step[k + 1] + 1 if k + 1 < len(step) else 0  # where the next lower step that occurs ends
        forest.threshold = float((step[k] + below) / 2 / STEPS)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(good, f0, f1, ...) of labelled rows that pass the base rules."""
    for batch in batches:
        c = {k: batch.column(k).to_numpy() for k in COUNTS + MORE}
        fine = ~_failed(c)
        x = features(c)[fine]
        good = batch.column("good").to_numpy(zero_copy_only=False)[fine] > 0
        yield pa.RecordBatch.from_arrays([pa.array(good), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["good", *_FEATURES])


def _stepped(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = forest.score(np.stack([batch.column(k).to_numpy() for k in _FEATURES], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.floor(score * STEPS).astype(np.int32)), batch.column("good")], ["step", "good"])


def fit(labelled: DataFrame, drawn: int = DRAWN, seed: int = 0) -> Forest | None:
    """The forest of all labelled rows (good, features), with its threshold; None if one kind is missing."""
    told = {r.good: r for r in labelled.groupBy("good").agg(F.count("*").alias("n"), *[f(k).alias(f"{n}_{k}") for k in _FEATURES for n, f in (("mean", F.avg), ("var", F.var_pop))]).collect()}
    if len(told) < 2:
        return None
    mean, var = ({g: np.array([r[f"{n}_{k}"] for k in _FEATURES]) for g, r in told.items()} for n in ("mean", "var"))
    apart = np.round(np.abs(mean[True] - mean[False]) / np.sqrt(var[True] + var[False] + 1e-12), 9)  # sums differ by their order

    def some(good: bool, n: int) -> np.ndarray:
        order = [F.xxhash64(F.lit(seed), *_FEATURES), *_FEATURES]  # by value, so the same on any cluster; equal rows are alike
        return labelled.where(F.col("good") == good).orderBy(*order).limit(n).select(*_FEATURES).toPandas().to_numpy()

    few = max(1, min(told[True].n, drawn) // CONTAMINATION)
    forest = grow(np.concatenate([some(True, drawn), some(False, few)]), apart**2 + 1e-3, seed)
    steps = labelled.mapInArrow(lambda it: _stepped(it, forest), "step int, good boolean").groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("step")  # at most a row a step
    place_threshold(forest, *(steps[k].to_numpy() for k in ("step", "good", "bad")))
    return forest


def _failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def _judged(batches: Iterator[pa.RecordBatch], forest: Forest | None) -> Iterator[pa.RecordBatch]:
    own = 1 + len(COUNTS + MORE)
    for batch in batches:
        c = {k: batch.column(k).to_numpy() for k in COUNTS + MORE}
        failed = _failed(c)
        score = forest.score(features(c)) if forest else np.zeros(len(failed))
        kept = ~failed & (score < forest.threshold if forest else True)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(score), *batch.columns[own:]], ["id", *COUNTS, "base_failed", "kept", "anomaly", *batch.schema.names[own:]])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", sample: int = DRAWN, tagged: bool = False) -> DataFrame:
    """A row a row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly; if ``tagged``, tag (the text's hash). ``sample`` good rows are what all trees draw together."""
    session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.xxhash64(text_col).alias("tag")] if tagged else []))
    tag = ", tag long" if tagged else ""
    counts = written(rows.mapInArrow(_measured, f"id {kind}, " + ", ".join(f"{k} long" for k in COUNTS + MORE) + tag), "quality-counts")
    known = labels.select(F.col(id_col).alias("id"), F.col(good_col).alias("good")).where("id is not null and good is not null")
    labelled = written(counts.join(known, "id").select("good", *COUNTS, *MORE).mapInArrow(_featured, "good boolean, " + ", ".join(f"{k} double" for k in _FEATURES)), "quality-labelled")
    forest = fit(labelled, sample)
    out = counts.mapInArrow(lambda it: _judged(it, forest), f"id {kind}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, anomaly double" + tag)
    return out.withColumnRenamed("id", id_col)
