"""MinHash near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, connected components.

A text's set is its distinct shingles of ``shingle`` words (the whole sequence as one shingle if it has fewer
words); texts with equal sets form one class, and classes are the nodes from there on. Each bucket of a band has a hub,
the class that shares most with others, and its other classes are compared with the hub alone, never all with all.

Links between classes of one hub that lie in different components after that are looked for by their differences from
the hub. Let x have d shingles of the hub c not and a more, and e = 100 d + t a for a similarity of t per cent. Then x and
y are linked if and only if (100 + t) o >= e(x) + e(y) - (100 - t) |c|, with o the number of shingles in which their
differences agree; without any agreement both are linked to the hub. So only pairs count in which one, x, is not linked to
the hub, and two prefix filters find them, with the added shingles before the missing ones and rare ones first in both:

- linked sets share one of the first |x| - t|x| + 1 shingles of each, so either one of that many added shingles, or both
  have fewer added ones than that;
- in the latter case the differences of each but o - 1 must share one, with o at least as the formula asks of x (or y) alone.

What is rare is estimated by counts in a fixed number of slots; any order finds all pairs, a good one finds few others.
Who shares a shingle of such a prefix is first compared with one of those who do, not linked to the hub if there is one,
and again while components grow together; only then are those that are still in different components compared pair by
pair. Nothing is capped: no link that banding finds is lost, and copies of a kind cost about one comparison a member.

Defined results: null, empty and blank texts have no shingles, link with nothing and are kept; repeated rows
give a row each; rows with a null id are grouped like others but never name a component unless all ids in it are null.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import discarded, lean, scratch, session, written

BANDS, ROWS = 30, 5
#: Bits that tell which texts may be needed again. With many more candidates than bits the join alone tells.
BITMAP = 1 << 22
#: Slots that shingles are counted in, and slots of one row of counts.
COUNTED, COUNTS_ROW = 1 << 20, 1 << 14
#: Bytes of ids up to which they are broadcast to where sets lie, and bytes that a row is reckoned at.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 160
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a run."""
    words, first, _ = H.runs(data, offsets, H.SPACE, H.LOWER)
    cut = np.searchsorted(first, offsets)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = words[a:b]
        out.append(np.unique(H.grams(own, min(shingle, len(own)))) if len(own) else np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` values a set (all sets non-empty).

    Every element walks a random permutation of the bins; at step j it offers j plus a fraction to the j-th bin of
    its walk, so a bin that was filled at an earlier step can't change any more. All elements of a batch take
    step j together, and a set stops as soon as all its bins are filled.
    """
    sizes = np.array([len(s) for s in sets])
    if not len(sizes):
        return np.zeros((0, m), np.uint64)
    out = np.full(len(sets) * m, _EMPTY)
    item, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    walk = None
    for j in range(m):
        x = H.mix(item + np.uint64((0xA0761D6478BD642F * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            bins = k
        else:
            rows = np.arange(len(item))
            bins = walk[rows, k].astype(np.int64)
            walk[rows, k] = walk[:, j]
        at = owner * m + bins
        open_ = out[at] == _EMPTY
        np.minimum.at(out, at[open_], (x[open_] & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
        full = (out.reshape(-1, m) != _EMPTY).all(axis=1)
        more = ~full[owner]
        if not more.any():
            break
        item, owner = item[more], owner[more]
        if j == 0:
            walk = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(item), 1))
            walk[np.arange(len(item)), bins[more]] = 0
        else:
            walk = walk[more]
    return out.reshape(-1, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        key = H.mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


def _class_of(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return H.mix(own).sum(dtype=np.uint64).tobytes() + H.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes()


def _signed(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in H.slices(batch.column(1)):
            sets = sets_of(data, offsets, shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = band_keys(super_minhash([sets[i] for i in full], bands * rows), bands, rows).astype(np.int64)
            counts = np.zeros(len(sets) + 1, np.int32)
            counts[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(sets)), pa.array(sizes), pa.array([_class_of(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(counts), pa.array(keys.ravel())), *(x.slice(at, len(sets)) for x in batch.columns[2:])],
                ["id", "n", "cls", "bands", *batch.schema.names[2:]],
            )


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Which of ``BITMAP`` slots the ids hash to: a fixed number of bits, however many ids there are."""
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP)).cast("int")
    rows = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, s % 64)")).alias("bits")).collect()
    out = np.zeros(BITMAP // 64, np.int64)
    for r in rows:
        out[r.word] = r.bits
    return out


def _full_sets(batches: Iterator[pa.RecordBatch], shingle: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = batch.column(0).to_numpy()
        batch = batch.filter(pa.array((bitmap[slot >> 6] >> (slot & 63)) & 1 == 1))
        for _, data, offsets in H.slices(batch.column(1)):
            sets = [s for s in sets_of(data, offsets, shingle) if len(s)]
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum([len(s) for s in sets])
            flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cls", "items"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b): the label is the smallest node that can be reached.

    Labels travel along edges and, by pointer jumping, along labels; every round is a written table."""
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = written(step.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")), "cc-labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def _few(table: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it is small."""
    return F.broadcast(table) if table.count() * ROW_BYTES <= BROADCAST_BYTES else table


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, ...), those whose full sets are as similar as asked. The set of a goes to where that of b is. Only sets that pairs name are shuffled, if pairs are few."""
    pairs = written(pairs, "near-pairs")
    few = _few(pairs)
    left = sets.join(few, sets["cls"] == few["a"]).select(*pairs.columns, F.col("items").alias("x"))
    right = sets if few is pairs else sets.join(F.broadcast(pairs.select(F.col("b").alias("cls")).distinct()), "cls", "left_semi")
    both = left.join(right.alias("r"), F.col("b") == F.col("r.cls")).withColumn("y", F.col("r.items")).withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select(*pairs.columns)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a task have a shingle of each slot, in rows of ``COUNTS_ROW`` slots."""
    total = np.zeros(COUNTED, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTED - 1), minlength=COUNTED)
    rows = total.reshape(-1, COUNTS_ROW)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([rows[k].tobytes() for k in used], pa.binary())], ["place", "counts"])


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"place": [key[0].as_py()], "counts": [total.tobytes()]})


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Counts by slot over all ``sets``: a fixed number of bytes, however many sets there are."""
    rows = sets.select("items").mapInArrow(_counted, "place long, counts binary").groupBy("place").applyInArrow(_summed, "place long, counts binary").collect()
    out = np.zeros((COUNTED // COUNTS_ROW, COUNTS_ROW), np.int64)
    for r in rows:
        out[r.place] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def prefix(x: np.ndarray, c: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, int, int, int, bool]:
    """Of a set and its hub: the shingles it is found by, how many of them count between two sets that aren't linked to the hub, e, a + d, and whether it isn't linked."""
    more, less = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
    a, d, per, limit = len(more), len(less), 100 + percent, (100 - percent) * len(c)
    e = 100 * d + percent * a
    far = e > limit
    alone = e // per + 1  # the least agreement with another that isn't linked to the hub
    need = max(1, -((limit - e) // per)) if far else alone
    if need > a + d:
        return x[:0], 0, e, a + d, far
    first = len(x) - -(-percent * len(x) // 100) + 1
    rare = lambda t: t[np.lexsort((t, counts[t & (COUNTED - 1)]))]
    if first <= a:
        return rare(more)[:first], first, e, a + d, far
    return np.concatenate([rare(more), rare(less)[: max(0, d - need + 1)]]), a + max(0, d - alone + 1), e, a + d, far


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, cs = ([v.values.to_numpy() for v in batch.column(k)] for k in ("x", "c"))
        found = [prefix(x, c, percent, counts) for x, c in zip(xs, cs, strict=True)]
        tokens, uu, e, s, far = zip(*found, strict=True) if found else ((),) * 5
        ends = np.concatenate([[0], np.cumsum(list(map(len, tokens)))]).astype(np.int32)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        limit = [(100 - percent) * len(c) for c in cs]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in ("hub", "cls", "label")), pa.array(limit, pa.int64()), pa.array(e, pa.int64()), pa.array(s, pa.int64()), pa.array(far, pa.bool_()), pa.array(uu, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))],
            ["hub", "cls", "label", "limit", "e", "s", "far", "uu", "tokens"],
        )


def _merged(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """``labels`` (..., label) with labels that are components of ``joined`` (node, label)."""
    to = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def _across(met: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``labels`` (cls, label) after the links between classes of one hub that are in different components."""
    own = written(met.select("hub", "cls").join(labels, "cls"), "near-own")
    mixed = own.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("hub")
    own = written(own.join(mixed, "hub").select("hub", "cls", "label"), "near-mixed")
    hubs = written(own.select("hub").distinct(), "near-mixed-hubs")
    central = sets.join(_few(hubs), F.col("cls") == F.col("hub")).select("hub", F.col("items").alias("c"))
    own = sets.join(_few(own), "cls").select("hub", "cls", "label", F.col("items").alias("x")).join(central, "hub").select("hub", "cls", "label", "x", "c")
    counts = _frequencies(sets)
    kinds = "hub binary, cls binary, label binary, limit long, e long, s long, far boolean, uu long, tokens array<long>"
    made = written(own.mapInArrow(lambda it: _prefixes(it, percent, counts), kinds), "near-prefixes")
    index = made.select("hub", "cls", "label", "limit", "e", "s", "far", "uu", F.posexplode("tokens").alias("k", "t")).withColumn("uu", F.col("k") < F.col("uu")).drop("k")

    def shared(index: DataFrame) -> DataFrame:
        """Of the rows, those whose shingle is one of classes in different components, one of which isn't linked to the hub."""
        groups = index.groupBy("hub", "t").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("far").alias("any"), F.min(F.struct(~F.col("far"), F.xxhash64("cls"), "cls", "label", "e", "s", "far", "uu")).alias("head"))
        groups = groups.where("low != high AND any")
        return index.join(groups.select("hub", "t", *[F.col(f"head.{k}").alias(f"h{k}") for k in ("cls", "label", "e", "s", "far", "uu")]), ["hub", "t"])

    def able(a: str, b: str) -> F.Column:
        far, uu = F.col(f"{a}far") & F.col(f"{b}far"), F.col(f"{a}uu") & F.col(f"{b}uu")
        agree = F.least(f"{a}s", f"{b}s") * (100 + percent) >= F.col(f"{a}e") + F.col(f"{b}e") - F.col("limit")
        return (F.col(f"{a}label") != F.col(f"{b}label")) & (F.col(f"{a}far") | F.col(f"{b}far")) & (~far | uu) & agree

    while True:
        last, made = made, written(shared(index), "near-index")
        discarded(last)
        index = made
        pairs = index.where(able("", "h")).select(F.col("hcls").alias("a"), F.col("cls").alias("b"), F.col("hlabel").alias("la"), F.col("label").alias("lb")).distinct()
        links = written(_links(pairs, sets, percent), "near-links")
        if not links.limit(1).count():
            break
        joined = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        labels, index = written(_merged(labels, joined), "near-labels"), _merged(index.select("hub", "t", "cls", "label", "limit", "e", "s", "far", "uu"), joined)
    sides = (index.select("hub", "t", *(["limit"] if k == "a" else []), *[F.col(c).alias(f"{k}{c}") for c in ("cls", "label", "e", "s", "far", "uu")]) for k in "ab")
    left, right = sides
    # those of whom one is the head have been compared
    left = left.join(index.select("hub", "t", "hcls").distinct(), ["hub", "t"]).where("acls != hcls")
    pairs = left.join(right, ["hub", "t"]).where((F.col("acls") < F.col("bcls")) & (F.col("bcls") != F.col("hcls")) & able("a", "b"))
    links = written(_links(pairs.select(F.col("acls").alias("a"), F.col("bcls").alias("b"), F.col("alabel").alias("la"), F.col("blabel").alias("lb")).distinct(), sets, percent), "near-links")
    if not links.limit(1).count():
        return labels
    return _merged(labels, components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))))


def _grouped(docs: DataFrame, kind: str, shingle: int, percent: int, bands: int, rows: int, tag: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each row's class and number of shingles, and each class's component."""
    banded = written(docs.select("id", "text", *[F.xxhash64("text").alias(x) for x in tag]).mapInArrow(lambda it: _signed(it, shingle, bands, rows), f"id {kind}, n long, cls binary, bands array<long>" + "".join(f", {x} long" for x in tag)), "near-banded")
    dealing = written(banded.where("n > 0").groupBy("cls").agg(F.min(F.struct("id", "bands")).alias("m"), F.min("id").alias("least"), F.max("n").alias("n")).select("cls", "least", "n", F.col("m.bands").alias("bands")), "near-dealing")
    # bands are most of these tables, and each is read for them once
    signed = written(banded.drop("bands"), "near-signed")
    discarded(banded)
    dealt = dealing.select("cls", "n", F.explode("bands").alias("bucket"))
    placed = written(dealt.withColumn("c", F.count("*").over(Window.partitionBy("bucket"))).where("c > 1"), "near-placed")
    classes = written(dealing.select("cls", "least"), "near-classes")
    discarded(dealing)
    central = written(placed.groupBy("cls").agg(F.sum("c").alias("score")), "near-central")
    hubs = written(placed.join(central, "cls").groupBy("bucket").agg(F.max(F.struct("score", "cls", "n")).alias("hub")), "near-hubs")
    met = placed.join(hubs, "bucket").select(F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hn"), "cls", "n").where("cls != hub").distinct()
    met = written(met, "near-met")
    discarded(placed)
    # sets are made where the texts lie: a bitmap tells most texts that have no part in this, the join the others
    bitmap = _bitmap(central.join(classes, "cls").select(F.col("least").alias("id")))
    made = docs.select(F.pmod(F.xxhash64("id"), F.lit(BITMAP)).cast("int").alias("slot"), "text").mapInArrow(lambda it: _full_sets(it, shingle, bitmap), "cls binary, items array<long>")
    sets = written(made.join(central.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("items").alias("items")), "near-sets")

    close = F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent  # sizes that can reach the similarity
    edges = written(_links(met.where(close).select(F.col("hub").alias("a"), F.col("cls").alias("b")), sets, percent), "near-links")
    labels = central.select("cls").join(components(edges).withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"))
    labels = _across(met, written(labels, "near-labels"), sets, percent)
    grouped = written(labels.join(classes.select("cls", "least"), "cls"), "near-grouped")
    lowest = written(grouped.groupBy("label").agg(F.min("least").alias("component")), "near-lowest")
    named = written(classes.select("cls", "least").join(grouped.join(lowest, "label").select("cls", "component"), "cls", "left").select("cls", F.coalesce("component", "least").alias("component")), "near-named")
    return signed, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, tagged: bool = False) -> DataFrame:
    """One row a row of ``docs``: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id); if ``tagged``, tag (the text's hash).

    Banding with the default 30 bands of 5 rows misses a pair at a similarity of exactly 0.8 with a chance of 7e-6.
    """
    spark = session(docs)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    tag = ["tag"] if tagged else []
    with scratch(spark, "near-signed", "near-named"), lean(spark):
        signed, named = _grouped(docs, kind, shingle, percent, bands, rows, tag)
    out = signed.select("id", "n", "cls", *tag).join(named, "cls", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"), *tag)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
