"""Sharding over fixed virtual slots, with DataFrame functions only.

A record's id hashes to one of ``SLOTS`` slots; a stored, versioned map gives each slot's shard. Version n of the map
has n shards and is version n - 1 edited: the new shard takes its share of slots, one at a time from the shard that
has most (of equal ones, the first), and nothing else moves. So a record's shard follows from its id and the
number of shards alone. Bytes and rows per slot are aggregated and stored beside the map; ``rebalanced`` edits a map by
them, for whoever prefers even bytes to a map that needs no data.

Defined results: a null text has no bytes; null ids share a slot; repeated rows get a row and a place each; an empty
table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session, written

SLOTS = 4096
HEADER_BYTES = 16
SALTS = 16


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot in version ``shards`` of the map."""
    owned = [list(range(slots))]
    for n in range(2, shards + 1):
        new: list[int] = []
        for _ in range(slots // n):
            giver = max(owned, key=len)
            new.append(giver.pop())
        owned.append(new)
    out = [0] * slots
    for shard, own in enumerate(owned):
        for slot in own:
            out[slot] = shard
    return out


def stored_map(spark: SparkSession, versions: list[int], slots: int = SLOTS) -> DataFrame:
    """(version, vslot, shard) of the given versions, as a written table of ``slots`` rows a version."""
    rows = [(v, slot, shard) for v in versions for slot, shard in enumerate(slot_map(v, slots))]
    return written(spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1), "slot-map")


def rebalanced(current: DataFrame, loads: DataFrame, shards: int, version: int, room: float = 1.02) -> DataFrame:
    """A new version of a map over ``shards`` shards with evened bytes: slots leave only shards above ``room`` times their share.

    ``current`` (vslot, shard) and ``loads`` (vslot, bytes) have a row a slot, a number that doesn't grow with the data.
    """
    spark = session(current)
    rows = current.join(loads, "vslot", "left").select("vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes")).orderBy("vslot").collect()
    held = [0] * shards
    for r in rows:
        held[r.shard] += r.bytes
    share = sum(held) / shards
    out = {r.vslot: r.shard for r in rows}
    for r in sorted(rows, key=lambda r: (-r.bytes, r.vslot)):
        to = min(range(shards), key=lambda s: (held[s], s))
        if held[r.shard] > room * share and held[to] + r.bytes < held[r.shard]:
            held[r.shard], held[to], out[r.vslot] = held[r.shard] - r.bytes, held[to] + r.bytes, to
    return spark.createDataFrame([(version, k, v) for k, v in out.items()], "version int, vslot int, shard int")


def placed(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """A row a row of ``docs``: id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard, vslot."""
    spark = session(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + HEADER_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("vslot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int"))
    # places are counted within a slot and a salt, so that a slot that repeated rows make heavy is counted in parts
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("text_crc32", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")), "slot-rows")
    maps = stored_map(spark, [shards, shards + 1], slots)
    both = maps.groupBy("vslot").agg(F.max(F.when(F.col("version") == shards, F.col("shard"))).alias("shard"), F.max(F.when(F.col("version") == shards + 1, F.col("shard"))).alias("grown_shard"))
    loads = written(rows.groupBy("vslot", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "slot-loads")  # at most slots * salts rows
    order = Window.partitionBy("shard").orderBy("vslot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = loads.join(F.broadcast(both), "vslot").select("vslot", "salt", "shard", "grown_shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy("vslot", "salt").orderBy("id", "text_crc32", "size")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(begins), ["vslot", "salt"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begin") + F.col("place")).alias("slot"), "grown_shard", "vslot")
