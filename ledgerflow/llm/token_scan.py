"""Token counts from flat, unindexed token files by a scan for end-of-document ids.

The files hold nothing but ids of fixed width. They are read in blocks by their size alone: each block is searched for
the end id with numpy, and a prefix scan over the blocks' counts and last ends stitches documents that blocks cut.

The width of an id follows from the vocabulary, unless a width is given; an id that doesn't fit raises an error.

Defined results: a null or empty text is a document of no ids; repeated rows count each; extra columns are ignored;
an empty table gives no file and no row. Ids after a file's last end id form no document and raise an error, as does
a file whose length is no multiple of the width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, tokens
from .common import session, shared_dir, written

BLOCK_BYTES = 4 << 20
FILE_BYTES = 512 << 20


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, leading_space: bool, end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq, file, docs = TaskContext.get().partitionId(), 0, None, 0
    encode = tokens.encoder(path, leading_space, special=False).encode
    for batch in batches:
        for at, texts in tokens.blocks(batch.column(1).to_pylist()):
            flat, counts = encode(texts)
            if file and file.size >= FILE_BYTES:
                file.commit()
                file, seq, docs = None, seq + 1, 0
            file = file or store.Committed(folder, f"part-{part:05d}-{seq:05d}.ids")
            ids = np.insert(flat, np.cumsum(counts), end_id)
            if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                raise ValueError(f"id {int(ids.max())} does not fit in {kind}")
            file.write(ids.astype(kind).tobytes())
            n = len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([file.name] * n), pa.array(np.arange(docs, docs + n))], ["id", "file", "ordinal"])
            docs += n
    if file:
        file.commit()


def width_of(path: str, end_id: int) -> str:
    """The least width that holds all ids of a vocabulary and the end id."""
    return "<u2" if max(tokens.encoder(path, False).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def write_flat(docs: DataFrame, folder: str, path: str, leading_space: bool, end_id: int, kind: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a flat file of ids for each task; returns which document is the how-manieth of which file."""
    session(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(lambda it: _write(it, folder, path, leading_space, end_id, kind), f"id {docs.schema[id_col].dataType.simpleString()}, file string, ordinal long"), "flat-order")


def _sized(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = store.place(folder)
    for batch in batches:
        names = batch.column(0).to_pylist()
        sizes = [x.size for x in fs.get_file_info([f"{root}/{n}" for n in names])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["file", "bytes"])


def _scan(batches: Iterator[pa.RecordBatch], folder: str, end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    fs, root = store.place(folder)
    width = np.dtype(kind).itemsize
    for batch in batches:
        for name, block, at, size in zip(*(batch.column(k).to_pylist() for k in ("file", "block", "at", "size")), strict=True):
            if size % width:
                raise ValueError(f"{name} ends within an id")
            with fs.open_input_file(f"{root}/{name}") as f:
                ids = np.frombuffer(f.read_at(size, at), kind)
            ends = np.flatnonzero(ids == end_id) + at // width
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([(at + size) // width])], ["file", "block", "ends", "stop"])


def scan(files: DataFrame, folder: str, end_id: int, kind: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a document of the files named in ``files`` (file): file, ordinal, start, n_tokens without its end id."""
    session(files)
    block_bytes -= block_bytes % np.dtype(kind).itemsize
    sized = files.select("file").distinct().mapInArrow(lambda it: _sized(it, folder), "file string, bytes long").where("bytes > 0")
    last = F.floor((F.col("bytes") - 1) / block_bytes)
    blocks = sized.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.select("file", "block", (F.col("block") * block_bytes).alias("at")).join(sized, "file").withColumn("size", F.least(F.lit(block_bytes), F.col("bytes") - F.col("at"))).repartition("file", "block")
    found = written(blocks.mapInArrow(lambda it: _scan(it, folder, end_id, kind), "file string, block long, ends array<long>, stop long"), "flat-ends")
    tails = found.groupBy("file").agg(F.max("stop").alias("stop"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("last"))
    if left := tails.where("last + 1 < stop").limit(5).collect():
        raise ValueError(f"ids after the last end id in {[(r.file, r.stop - r.last - 1) for r in left]}")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    carried = carried.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    rows = found.where(F.size("ends") > 0).join(carried, ["file", "block"]).select("file", "first", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    return rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, leading_space: bool, end_id: int, kind: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, file, ordinal, start, n_tokens, all from a scan of flat files of its ids."""
    folder = shared_dir(session(docs), "flat")
    kind = kind or width_of(path, end_id)
    order = write_flat(docs, folder, path, leading_space, end_id, kind, id_col, text_col)
    return order.join(scan(order, folder, end_id, kind), ["file", "ordinal"], "left").select(F.col("id").alias(id_col), "file", "ordinal", "start", "n_tokens")
