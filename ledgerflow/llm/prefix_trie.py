"""Prefix trie of conversations by the recursion of van Emde Boas: sequences are cut at half depth, again and again.

The trie is tables: a node is a name, and names come from halves. On the way up, turns are named by their content and
blocks of 2, 4, 8 ... turns by the names of their halves. On the way down a block hands its forest's root to both halves: the upper half keeps
it, the lower one hangs below the prefix at the cut, named by the root and the upper half. After as many rounds as the
depth has binary digits every prefix of every conversation has its name, and equal prefixes have equal ones. Totals of subtrees go the same way: blocks of one
depth know their own; in each round, all pairs of an upper trie and its lower forests are joined at once, as the sums of the lower
ones are grafted on the cut nodes' ancestors within the upper one. So a trie of depth D takes about log2(D) rounds of N rows each, and no
conversation, node or group of copies is ever gathered in one task.

Defined results: rows without a conversation id belong to none; a null turn comes first, rows of one turn go by role and text; a null role or text is
empty; repeated rows are turns of their own; extra columns are ignored; an empty table has no node, not even a root.
Names are SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, written

#: A conversation takes its head from the first of so many; how many turns, follows from its id.
FAMILY, HEADS = 20, 4
#: Bytes of a piece of a node's list of ids, on the way to its digest.
PIECE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def _name(*parts: Column | str) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, token, words): each conversation's turns in order, named by role and text, with the words of the text.

    The order comes from a sort by ranges of id, turn and text, and from counts of each task's rows of a conversation, which may
    lie in many tasks.
    """
    session(conversations)
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    dealt = rows.withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "salt"]
    token = _name(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    placed = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", token.alias("token"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("place"))
    placed = written(placed, "trie-turns").withColumn("part", F.shiftright("place", 33))
    first = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    # how many turns of a conversation lie in the tasks before: it has a row a task here
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = first.select("conv_id", "part", (F.coalesce(F.sum("here").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(begins, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("pos"), "token", "words")


def with_heads(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations, and all conversations' ids: id c begins with the first crc32(c) % ``heads`` turns of c - c % ``family``, then has its own after as many."""
    take = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("size")).withColumns({"take": take, "base": F.col("conv_id") - F.col("conv_id") % family})
    base = turns.where((F.col("pos") < heads - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "pos", "token", "words")  # a few rows a family
    borrowed = convs.join(base, "base").where(F.col("pos") < F.col("take")).select("conv_id", "pos", "token", "words")
    # own turns move up where the base has too few
    have = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("have"))
    lack = convs.join(have, "base", "left").select("conv_id", (F.col("take") - F.least("take", F.coalesce("have", F.lit(0)))).alias("lack")).where("lack > 0")
    own = turns.where(F.col("pos") >= take).join(lack, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "token", "words")
    return borrowed.unionByName(own), convs.select("conv_id")


def _paths(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, depth, node, words, ends): the node of each prefix of each conversation, the empty one too; and the rounds it took."""
    none, no_words = F.lit(None).cast("binary"), F.lit(0).cast("long")
    steps = turns.select("conv_id", F.col("pos").alias("i"), "token", no_words.alias("words"))
    steps = steps.unionAll(turns.select("conv_id", F.col("pos") + 1, none, "words")).unionAll(convs.select("conv_id", F.lit(0).cast("long"), none, no_words))
    # at i: the turn that follows the prefix of i turns, null at the end, and the words of the one before
    grid = written(steps.groupBy("conv_id", "i").agg(F.max("token").alias("token"), F.max("words").alias("words")), "trie-grid")
    deepest = grid.agg(F.max("i")).first()[0] or 0
    rounds = max(1, int(deepest).bit_length())
    left, right = F.col("i") % 2 == 0, F.col("i") % 2 == 1
    names, pairs = grid.withColumnRenamed("token", "name"), []
    for level in range(rounds):
        more = [F.max(F.when(left, F.col("words"))).alias("words_l"), F.max(F.when(right, F.col("words"))).alias("words_r")] if not level else []
        both = names.groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(left, F.col("name"))).alias("l"), F.max(F.when(right, F.col("name"))).alias("r"), F.max(right).alias("two"), *more)
        pairs.append(written(both, "trie-pairs"))
        names = pairs[-1].select("conv_id", "i", F.when(F.col("r").isNotNull(), _name("l", "r")).alias("name"))
    roots = pairs[-1].select("conv_id", "i", _name(F.lit("root")).alias("root"))
    for level in range(rounds - 1, -1, -1):
        halves = pairs[level].join(roots, ["conv_id", "i"])
        more = [F.col("words_l").alias("words"), F.col("l").isNull().alias("ends")], [F.col("words_r").alias("words"), F.col("r").isNull().alias("ends")]
        upper = F.struct((F.col("i") * 2).alias("i"), F.col("root").alias("root"), *more[0][: 0 if level else 2])
        lower = F.struct((F.col("i") * 2 + 1).alias("i"), _name("root", "l").alias("root"), *more[1][: 0 if level else 2])
        roots = halves.select("conv_id", "two", F.explode(F.array(upper, lower)).alias("x")).where((F.col("x.i") % 2 == 0) | F.col("two")).select("conv_id", "x.*")
    return written(roots.select("conv_id", F.col("i").alias("depth"), F.col("root").alias("node"), "words", "ends"), "trie-paths"), rounds


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Ids of each node, which come in order, as pieces of comma-joined text."""
    from pyspark import TaskContext

    part, made, node, ids, size, number = TaskContext.get().partitionId(), [], None, [], 0, 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.binary()), pa.array([part] * len(made), pa.int32()), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.string())], ["node", "part", "number", "ids"])
        made.clear()
        return out

    for rows in batches:
        for name, conv in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            if ids and (name != node or size >= most):
                made.append((node, number, ",".join(ids)))
                number, ids, size = number + 1, [], 0
                if len(made) >= 1024 or len(made[-1][2]) >= most:
                    yield batch()
            node = name
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        made.append((node, number, ",".join(ids)))
    if made:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, joined."""
    node, seen, found = None, None, []
    for rows in batches:
        for name, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            if name != node:
                if seen:
                    found.append((node, seen.hexdigest()))
                node, seen = name, hashlib.sha256()
            else:
                seen.update(b",")
            seen.update(ids.encode())
        if len(found) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["node", "sha"])
            found = []
    if seen:
        found.append((node, seen.hexdigest()))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["node", "sha"])


def id_digests(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, sha) of rows (node, conv_id): the hash of each node's ids in ascending order. Pieces are made by ranges; one task a node only hashes them, as a stream."""
    pieces = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(lambda it: _pieces(it, piece), "node binary, part int, number long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "part", "number").select("node", "ids").mapInArrow(_digests, "node binary, sha string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are rows (conv_id, pos, token, words) with positions from 0; ``convs`` has every conversation's id.
    """
    paths, rounds = _paths(turns, convs)
    named = written(paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "trie-nodes")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = written(named.join(above, ["conv_id", "depth"], "left"), "trie-parents")
    children = written(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "trie-children")
    totals = nodes.join(children, "node", "left").select("node", "parent", "conv_id", "depth", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    for level in range(1, rounds + 1):
        totals = written(totals, "trie-totals")
        half = 2 ** (level - 1)
        # lower forests hang at the middle of each block; a member of theirs leads through the upper trie
        block = F.floor((F.col("depth") - 1) / half)
        grafts = totals.where(F.col("depth") % (2 * half) == half).groupBy("parent").agg(F.min("conv_id").alias("conv_id"), F.first(block).alias("block"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        upper = paths.select("conv_id", "node", F.floor(F.col("depth") / half).alias("block"))
        more = grafts.join(upper, ["conv_id", "block"]).groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        totals = totals.join(more, "node", "left").select("node", "parent", "conv_id", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
    parents = named.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = id_digests(paths.where("ends").select("node", "conv_id"))
    out = totals.join(named.select("node", "n_convs"), "node").join(children, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", count("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of rebuilt conversations."""
    turns, convs = with_heads(turns_of(conversations, conv_col, turn_col, role_col, text_col), family, heads)
    return trie(turns, convs)


#: Every prefix as a string of hashes; ancestors by all pairs of prefixes of a conversation.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS token, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(conv_id AS varchar), ''), lambda x: ascii(x)::ubigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, (u & 1) * 3988292384::ubigint))), 4294967295::ubigint) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.p, token, words FROM c JOIN t ON t.conv_id = c.base AND t.p < c.h UNION ALL SELECT c.conv_id, 1, t.p, token, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.p >= c.h),
s AS (SELECT conv_id, row_number() OVER w AS d, string_agg(token, ',') OVER w AS node, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, p ROWS UNBOUNDED PRECEDING)),
x AS (SELECT conv_id, d, node, words FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT node, sha256(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(node, d) AS node FROM x GROUP BY conv_id) GROUP BY node),
n AS (SELECT node, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM x GROUP BY node),
q AS (SELECT n.*, y.node AS parent FROM n LEFT JOIN x y ON y.conv_id = n.conv_id AND y.d = n.d - 1),
k AS (SELECT parent, count(*) AS n_children FROM q WHERE parent IS NOT NULL GROUP BY parent),
a AS (SELECT DISTINCT u.node AS top, v.node AS node FROM x u JOIN x v ON u.conv_id = v.conv_id AND u.d <= v.d),
b AS (SELECT a.top, sum(CASE WHEN k.parent IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved FROM a JOIN n USING (node) LEFT JOIN k ON k.parent = a.node GROUP BY a.top)
SELECT q.conv_id, q.d AS depth, m.conv_id AS parent_conv_id, q.n_convs, coalesce(n_children, 0) AS n_children, cast(n_leaves AS bigint) AS n_leaves, cast(saved AS bigint) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM q JOIN b ON b.top = q.node LEFT JOIN n m ON m.node = q.parent LEFT JOIN k ON k.parent = q.node LEFT JOIN e ON e.node = q.node
"""
