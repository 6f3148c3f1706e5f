"""Phrase collocations by set-oriented mining (SETM) over blocks of texts.

Level k is an occurrence relation: (block, position, group), sorted by position, where positions jump at the ends of pieces.
A level's groups are counted by Spark over all blocks; those that occur often enough get dense numbers, go back
to the blocks that have them (the semi-join), and the relation of the next level comes from a merge-join of what is left with
itself at the next position. So a phrase of k + 1 words is named by the numbers of its first and its last k words: exact, no
hashes. Each level's relation is a written table; a block counts its own groups before anything is shuffled, so a phrase that
a third of all texts have costs a row a block, and one shuffle of those rows both counts and semi-joins.

A phrase's score is the lowest of floor(1000 * f * n / (l * r)) over its cuts into two parts that occur l and r times.

Defined results: a null text is empty; a null lang counts as ``und``; an empty table or one without frequent phrases gives no row; repeated rows
count each; extra columns are ignored; a word or piece of any length stays whole; ties of the score go by f, then by
the phrase's bytes. Arithmetic is exact up to 10**38 (``1000 * f * n``) and raises beyond; more than 2**31 frequent groups of a length raise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import discarded, lean, scratch, session, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: A phrase goes if a longer one around it has at least this share of its occurrences, in hundredths.
INSIDE = 100
#: Bytes of text from which a block is closed, those that are worked on at a time, and rows that are parted by lang at a time.
BLOCK, SLICE, ROWS = 12 << 20, 1 << 20, 512
#: How relations are stored: sorted numbers by their differences.
STORED = {"compression": "zstd", "parquet.writer.version": "v2"}
UNKNOWN = "und"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_WORD = ~_SEPARATOR
_WORD[[9, 32]] = False
RELATION = "block long, lang string, n_groups int, size int, gaps binary, groups binary"


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a run of texts: each word's position, its number among the distinct words, and these. Positions of neighbours differ by 1 within a piece only."""
    folded, inside = H.LOWER[data], _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = offsets[:-1][offsets[:-1] < len(data)]
    first[opens] |= inside[opens]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    before = np.cumsum(inside, dtype=np.int32 if len(data) < 2**31 else np.int64)
    begin = np.append(before[starts] - 1, before[-1]).astype(np.int64)
    letters = folded[inside]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(begin), pa.py_buffer(letters)).dictionary_encode()
    ends = _SEPARATOR[data].astype(np.int8)
    ends[opens] += 1
    piece = np.cumsum(ends, dtype=before.dtype)[starts]
    jumps = np.zeros(len(starts), np.int64)
    np.cumsum(piece[1:] != piece[:-1], out=jumps[1:])
    return np.arange(len(starts)) + jumps, np.asarray(words.indices, np.int32), words.dictionary.cast(pa.string())


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a, np.int32), "zstd", asbytes=True)


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * size, "zstd"), np.int32)


def _row(block: int, lang: str | None, position: np.ndarray, group: np.ndarray, keys: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """A block's relation and its groups with their counts."""
    found = pa.StructArray.from_arrays([keys, pa.array(counts.astype(np.int32))], ["key", "n"])
    listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), found)
    head = [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([len(keys)], pa.int32()), pa.array([len(position)], pa.int32())]
    return pa.RecordBatch.from_arrays([*head, pa.array([_packed(np.diff(position, prepend=0))]), pa.array([_packed(group)]), listed], ["block", "lang", "n_groups", "size", "gaps", "groups", "found"])


def _merged(number: int, lang: str, parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    """One block of the parts' occurrences, with one number for each of its words."""
    groups = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(g), w) for _, g, w in parts]).unify_dictionaries()
    group, words = np.concatenate([c.indices.to_numpy() for c in groups.chunks]), groups.chunk(0).dictionary
    ends = np.append(0, np.cumsum([p[-1] + 2 for p, _, _ in parts[:-1]]))
    return _row(number, lang, np.concatenate([p + e for (p, _, _), e in zip(parts, ends, strict=True)]), group, words, np.bincount(group, minlength=len(words)))


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts of one lang; at most a few of them are open at a time, however many langs there are."""
    from pyspark import TaskContext

    number, parts, size = TaskContext.get().partitionId() << 32, {}, Counter()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            for lang in pc.unique(rows.column(0)).to_pylist():
                for _, data, offsets in H.slices(rows.column(1).filter(pc.equal(rows.column(0), lang)), SLICE):
                    found = occurrences(data, offsets)
                    if len(found[1]):
                        parts.setdefault(lang, []).append(found)
                        size[lang] += len(data)
                while size[lang] >= block_bytes or size.total() >= 3 * block_bytes:
                    full = lang if size[lang] >= block_bytes else max(size, key=size.get)
                    yield _merged(number, full, parts.pop(full))
                    number, size[full] = number + 1, 0
    for lang, own in parts.items():
        yield _merged(number, lang, own)
        number += 1


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next level's relation of each block: frequent groups that meet at neighbouring positions."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, n_groups, size = (batch.column(c)[row].as_py() for c in ("block", "n_groups", "size"))
            position = np.cumsum(_unpacked(batch.column("gaps")[row].as_py(), size), dtype=np.int64)
            group = _unpacked(batch.column("groups")[row].as_py(), size)
            known = batch.column("known")[row].values
            number = np.full(n_groups, -1, np.int64)
            number[known.field("at").to_numpy()] = known.field("id").to_numpy()
            here = number[group]
            position, here = position[here >= 0], here[here >= 0]
            meet = np.flatnonzero(position[1:] == position[:-1] + 1)
            if len(meet):
                if here.max() >= 2**31:
                    raise OverflowError("over 2**31 frequent groups of one length")
                keys, own, counts = np.unique(here[meet] << 32 | here[meet + 1], return_inverse=True, return_counts=True)
                yield _row(block, None, position[meet], own, pa.array(keys), counts)


def _numbered(often: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the number of each key's group, from 0 without gaps. All rows of a key lie in one part; numbers count within parts, whose sizes (a number a part) go before."""
    ranked = often.withColumn("id", F.dense_rank().over(Window.partitionBy("part").orderBy(*keys)).cast("long"))
    begin, begins = 0, []
    for part, size in sorted(tuple(r) for r in often.groupBy("part").agg(F.countDistinct(*keys)).collect()):
        begins += [F.lit(part), F.lit(begin - 1)]
        begin += size
    return ranked.withColumn("id", F.col("id") + F.create_map(*begins)[F.col("part")] if begins else F.col("id")).drop("part")


def _cuts(k: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of a phrase of ``k`` words; ties to the earliest."""
    cuts = []
    for i in range(1, k):
        l, r = f"get(pre, {i - 1})", f"get(suf, {k - i - 1})"  # noqa: E741
        score = f"(cast(1000 as decimal(4,0)) * cast(f as decimal(19,0)) * cast(n as decimal(19,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))"
        cuts.append(F.expr(f"struct({score} as score, {i} as k, {l} as l, {r} as r)"))
    return F.array_min(F.array(*cuts)) if k > 2 else cuts[0]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, block_bytes: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases of 2 to ``longest`` words that occur ``least`` times or more."""
    spark = session(docs)
    with lean(spark), scratch(spark, "setm-level", "setm-words"):
        rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
        found = "found array<struct<key:{},n:int>>"
        relation = written(rows.mapInArrow(lambda it: _blocks(it, block_bytes), f"{RELATION}, {found.format('string')}"), "setm-relation", **STORED)
        total = written(relation.select("lang", F.explode("found").alias("g")).groupBy("lang").agg(F.sum("g.n").alias("n")), "setm-words")
        levels: list[DataFrame] = []
        for k in range(1, longest + 1):
            keys = ["lang", "key"] if k == 1 else ["key"]
            groups = relation.select("block", "lang", F.posexplode("found").alias("at", "g")).select("block", "at", *keys[:-1], "g.key", "g.n")
            # a group has a row a block at most, so no key has more than its share of them
            counted = groups.withColumn("f", F.sum("n").over(Window.partitionBy(*keys))).where(F.col("f") >= least)
            often = _numbered(written(counted.select("block", "at", *keys, "f", F.spark_partition_id().alias("part")), "setm-often"), keys)
            counted = often.groupBy(*keys, "id").agg(F.first("f").alias("f"))
            if k == 1:
                made = counted.select("id", "lang", F.col("key").alias("phrase"), "f", F.array("f").alias("pre"), F.array("f").alias("suf"))
            else:
                left = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "pre")
                right = levels[-1].select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("last"), "suf")
                parts = counted.select("id", "f", F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit(2**32 - 1)).alias("right")).join(left, "left").join(right, "right")
                made = parts.select("id", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"))
            levels.append(written(made, "setm-level"))
            if k < longest:
                known = often.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("known"))  # a block's own groups, at most its words
                before, relation = relation, written(relation.select("block", "n_groups", "size", "gaps", "groups").join(known, "block").mapInArrow(_extended, f"{RELATION}, {found.format('long')}"), "setm-relation", **STORED)
                discarded(before)
    out = None
    for k, level in enumerate(levels[1:], 2):
        own = level
        if k < longest:  # what is within a phrase of any length is within one that is a word longer, with as many occurrences or more
            around = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("around")).groupBy("id").agg(F.max("around").alias("around"))
            own = level.join(around, "id", "left").where(F.coalesce(100 * F.col("around") < inside * F.col("f"), F.lit(True)))
        best = own.join(total, "lang").withColumn("cut", _cuts(k)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        out = best if out is None else out.unionByName(best)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Counts of all n-grams of all pieces, by brute force.
ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
h AS (SELECT DISTINCT a.lang, a.phrase FROM c a JOIN c b ON a.lang = b.lang AND a.k < b.k AND b.f >= a.f AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')),
x AS (SELECT lang, k, phrase, f, w, unnest(range(1, k)) AS i FROM c ANTI JOIN h USING (lang, phrase)),
y AS (SELECT x.lang, x.phrase, x.f AS a, x.i, l.f AS l, r.f AS r, t.n, (1000::hugeint * x.f * t.n) // (l.f::hugeint * r.f) AS score FROM x JOIN t USING (lang)
 JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.i], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.i + 1:], ' ')),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM y)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, cast(l AS bigint) AS l, cast(r AS bigint) AS r, cast(n AS bigint) AS n, cast(score AS bigint) AS score FROM z WHERE o = 1) WHERE rank <= 2000
"""
