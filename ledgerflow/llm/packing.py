"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A document longer than a sequence is cut into full pieces and a rest; full pieces are sequences of their own. The other
pieces are dealt at random over cells of about ``CELL`` pieces. On each cell several islands evolve packings whose
genes are whole bins, from best fits of pieces in orders that chance blurs: crossover injects well-filled bins of one
parent into the other, removes the bins that now hold a piece twice, and best-fits the displaced pieces; mutation opens
the emptiest bins and some others and fills new ones with the one or two pieces that leave least room. After an epoch each
island's elite migrates to the next island. An island rests when no packing can have fewer bins.
Bins that the best packing of their cell leaves under ``CLOSED`` full are opened and their pieces dealt and packed again.

Defined results: a null or empty text is a document of the end id alone; repeated rows are documents of their own; rows
with a null id are packed like others. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import session, written

CELL = 2_000
ISLANDS, EPOCHS = 3, 2
POPULATION, GENERATIONS = 5, 5
#: How far chance moves a size in the order of a first packing, and the share of bins that a mutation opens.
BLUR, OPENED = 0.5, 0.12
CLOSED = 0.995


def _pieces(batches: Iterator[pa.RecordBatch], path: str, leading_space: bool, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = tokens.encoder(path, leading_space).encode
    for batch in batches:
        for at, texts in tokens.blocks(batch.column(1).to_pylist()):
            flat, counts = encode(texts)
            ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            per = -(-counts // capacity)
            owner = np.repeat(np.arange(len(texts)), per)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(capacity, counts[owner] - start)
            begin = (np.cumsum(counts) - counts)[owner] + start
            view = memoryview(ids.tobytes())
            sums = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            keys = batch.column(0).take(pa.array(owner + at))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])


class Bins:
    """A packing under construction: open bins by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.load, self.rooms, self.by_room = capacity, [], 0, [[] for _ in range(capacity + 1)]

    def open(self, load: int) -> int:
        self.load.append(load)
        self._file(len(self.load) - 1)
        return len(self.load) - 1

    def _file(self, b: int) -> None:
        room = self.capacity - self.load[b]
        self.by_room[room].append(b)
        self.rooms |= 1 << room

    def best_fit(self, size: int) -> int:
        """The bin with the least room that is enough, or a new one."""
        fits = self.rooms >> size
        if not fits:
            return self.open(size)
        room = size + (fits & -fits).bit_length() - 1
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        self.load[b] += size
        self._file(b)
        return b


def best_fit(sizes: list[int], order: np.ndarray, capacity: int, given: np.ndarray | None = None) -> np.ndarray:
    """Bin numbers; ``given`` has those of pieces that are placed already (-1: to be placed)."""
    bins, out = Bins(capacity), np.full(len(sizes), -1) if given is None else given.copy()
    if given is not None and (given >= 0).any():
        kept = given >= 0
        numbers, out[kept] = np.unique(given[kept], return_inverse=True)
        for load in np.bincount(out[kept], np.asarray(sizes)[kept], len(numbers)).astype(int).tolist():
            bins.open(load)
    for i in order.tolist():
        if out[i] < 0:
            out[i] = bins.best_fit(sizes[i])
    return out


def worth(packing: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    load = np.bincount(packing, sizes)
    return -len(load), float(((load / capacity) ** 2).sum())


def crossover(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of ``other`` go into ``one``."""
    load = np.bincount(other, sizes)
    full = np.flatnonzero(load >= np.quantile(load, 0.5))
    chosen = np.zeros(len(load), bool)
    chosen[full[rng.random(len(full)) < 0.3]] = True
    injected = chosen[other]
    spoilt = np.zeros(one.max() + 1, bool)
    spoilt[one[injected]] = True
    given = np.where(injected, other + one.max() + 1, np.where(spoilt[one], -1, one))
    return best_fit(sizes.tolist(), np.lexsort((rng.random(len(sizes)), -sizes)), capacity, given)


def filled(sizes: np.ndarray, at: np.ndarray, capacity: int) -> list[list[int]]:
    """The pieces ``at`` in bins: each opens with the largest left and takes the one or two that leave least room, until none fits."""
    ids = at[np.argsort(sizes[at], kind="stable")]
    own, out = sizes[ids], []
    while len(ids):
        held, room = [int(ids[-1])], capacity - int(own[-1])
        ids, own = ids[:-1], own[:-1]
        while n := int(np.searchsorted(own, room, side="right")):
            taken = [n - 1]
            if n > 1 and own[n - 1] < room:
                partner = np.minimum(np.searchsorted(own[:n], room - own[:n], side="right") - 1, np.arange(n) - 1)
                pair = np.where(partner >= 0, own[:n] + own[np.maximum(partner, 0)], -1)
                best = int(pair.argmax())
                if pair[best] > own[n - 1]:
                    taken = [best, int(partner[best])]
            held += ids[taken].tolist()
            room -= int(own[taken].sum())
            ids, own = np.delete(ids, taken), np.delete(own, taken)
        out.append(held)
    return out


def mutated(packing: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    load = np.bincount(packing, sizes)
    n = min(len(load), max(2, int(OPENED * len(load))))
    opened = np.zeros(len(load), bool)
    opened[np.argpartition(load * rng.uniform(0.9, 1.0, len(load)), n - 1)[:n]] = True
    opened[rng.integers(0, len(load), max(1, n // 3))] = True
    number = np.cumsum(~opened) - 1
    out, bins = number[packing], len(load) - int(opened.sum())
    for held in filled(sizes, np.flatnonzero(opened[packing]), capacity):
        out[held] = bins
        bins += 1
    return out


def evolve(sizes: np.ndarray, capacity: int, starts: list[np.ndarray], seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The elite of one island after an epoch; ``starts`` are packings to begin with, if there are any."""
    rng, least = np.random.default_rng(seed), -(-int(sizes.sum()) // capacity)

    def rated(packing: np.ndarray) -> tuple[tuple[int, float], np.ndarray]:
        return worth(packing, sizes, capacity), packing

    members = [rated(p) for p in starts]
    while len(members) < population:
        blurred = sizes * rng.uniform(1 - BLUR, 1 + BLUR, len(sizes))
        members.append(rated(best_fit(sizes.tolist(), np.argsort(-blurred, kind="stable"), capacity)))
    for _ in range(generations):
        members.sort(key=lambda m: m[0], reverse=True)
        if -members[0][0][0] <= least:
            break
        a, b = sorted(rng.choice(population, 2, replace=False))
        members[-1] = rated(mutated(crossover(members[a][1], members[b][1], sizes, capacity, rng), sizes, capacity, rng))
    return max(members, key=lambda m: m[0])[1]


def _island(frame: pd.DataFrame, capacity: int, epoch: int) -> pd.DataFrame:
    """An epoch of one island: its own elite and the migrant, if any, as starts; the new elite."""
    frame = frame.sort_values(["immigrant", "row"], kind="stable").reset_index(drop=True)
    own, guest = frame[~frame.immigrant], frame[frame.immigrant]
    starts = [x.bin.to_numpy() for x in (own, guest) if len(x) == len(own) and x.bin.min() >= 0]
    bins = evolve(own.length.to_numpy(), capacity, starts, zlib.crc32(f"{own.cell.iloc[0]} {own.island.iloc[0]} {epoch}".encode()))
    out = own.assign(bin=bins)
    load = np.bincount(bins, own.length)
    out["bins"], out["fill"] = len(load), float(((load / capacity) ** 2).sum())
    out["load"] = load[bins].astype(np.int64)
    order = np.lexsort((own.row, bins))
    ends = np.cumsum(own.length.to_numpy()[order])
    offset = np.empty(len(own), np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[True], np.diff(bins[order]) > 0])
    offset[order] = begin - np.maximum.accumulate(np.where(first, begin, 0))
    return out.assign(offset=offset)


SHAPE = "row long, length long, cell long, island int, immigrant boolean, bin long, bins long, fill double, load long, offset long"


def _epoch(capacity: int, epoch: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _island(frame, capacity, epoch)[[column.split()[0] for column in SHAPE.split(", ")]]

    return run


def _evolved(parts: DataFrame, capacity: int, cell: int, level: int) -> DataFrame:
    """``parts`` (row, length, ...) with cell, bin, load and offset of the best packing of each cell."""
    n = max(1, -(-parts.count() // cell))
    dealt = parts.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(n)).alias("cell"))
    state = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(False).alias("immigrant"), F.lit(-1).cast("long").alias("bin"))
    for epoch in range(EPOCHS):
        if epoch:
            own = state.select("row", "length", "cell", "island", "immigrant", "bin")
            state = own.union(own.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS))).withColumn("immigrant", F.lit(True)))
        inputs = state.select("row", "length", "cell", "island", "immigrant", "bin")
        state = written(inputs.groupBy("cell", "island").applyInPandas(_epoch(capacity, epoch), SHAPE), "packing-epoch")
    best = state.groupBy("cell").agg(F.min(F.struct("bins", -F.col("fill"), "island"))["island"].alias("island"))
    return state.join(best, ["cell", "island"]).select("row", "length", "cell", "bin", "load", "offset")


def pack_documents(docs: DataFrame, path: str, leading_space: bool, end_id: int, capacity: int = 2048, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(lambda it: _pieces(it, path, leading_space, end_id, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = written(made.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    rest = pieces.where(F.col("length") < capacity).select("row", "length")
    first = _evolved(rest, capacity, cell, 0)
    full = F.col("load") >= CLOSED * capacity
    again = _evolved(first.where(~full).select("row", "length"), capacity, cell, 1)

    def numbered(df: DataFrame, level: int) -> DataFrame:
        return df.select("row", ((F.col("cell") * 2 + level) * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")

    placed = numbered(first.where(full), 0).union(numbered(again, 1))
    out = pieces.join(placed, "row", "left")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", -F.col("row") - 1).alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"))
