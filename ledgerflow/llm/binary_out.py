"""Token-id files by fixed-width bit packing, with random access.

File: 32 reserved bytes, then blocks of packed ids, low bits first, then the index (end offset and id of every
document, a null flag for each id, a CRC-32 for each block), then 32 trailer bytes (magic ``LFBP``, version, bits an
id, ids a block, ids, documents, place of the index). All integers are little-endian. A block of ``BLOCK_IDS`` ids
fills whole bytes at any width, so the place of any id follows from its number alone.

An id takes the fewest bits that hold the vocabulary and the end id, unless a width is given; an id that doesn't fit raises an
error, and so does a block whose CRC-32 isn't that of the index.

Defined results: a null text is empty; rows with equal ids keep an order by text; null ids come first. Extra columns
are ignored; an empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, tokens
from .common import session, shared_dir, written

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20
_TRAILER = struct.Struct("<4sHHIQIQ")
MANIFEST = "file string, part int, seq int, docs long, ids long, bytes long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, low bits first, up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids from ``data``, after ``skip`` bits."""
    if bits in (8, 16, 32) and not skip:
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    own = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip : skip + n * bits].reshape(n, bits)
    return (own.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    def __init__(self, folder: str, name: str, bits: int) -> None:
        self.file, self.bits = store.Committed(folder, name), bits
        self.file.write(b"\0" * _TRAILER.size)
        self.ends: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.sums: list[int] = []
        self.ids, self.held, self.wait = 0, [], 0

    def add(self, keys: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys += keys
        self.ends.append(self.ids + np.cumsum(counts))
        self.ids += len(ids)
        self.held.append(ids)
        self.wait += len(ids)
        if self.wait >= BLOCK_IDS:
            self._flush(self.wait // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, n: int) -> None:
        own = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for at in range(0, n, BLOCK_IDS):
            block = pack(own[at : min(n, at + BLOCK_IDS)], self.bits)
            self.sums.append(zlib.crc32(block))
            self.file.write(block)
        self.held, self.wait = [own[n:].copy()], len(own) - n

    def close(self) -> tuple[int, int, int]:
        if self.wait:
            self._flush(self.wait)
        index = self.file.size
        ends = np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)
        self.file.write(ends.astype("<i8").tobytes())
        self.file.write(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self.file.write(np.array([k is None for k in self.keys], np.uint8).tobytes())
        self.file.write(np.array(self.sums, "<u4").tobytes())
        self.file.write(_TRAILER.pack(b"LFBP", 1, self.bits, BLOCK_IDS, self.ids, len(self.keys), index))
        return len(self.keys), self.ids, self.file.commit()


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, folder: str, name: str) -> None:
        fs, root = store.place(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        magic, _, self.bits, self.block, self.ids, self.docs, index = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != b"LFBP":
            raise ValueError(f"{name} is no packed token file")
        raw = self.file.read_at(size - _TRAILER.size - index, index)
        self.ends = np.frombuffer(raw, "<i8", self.docs)
        self.sums = np.frombuffer(raw, "<u4", -(-self.ids // self.block), 17 * self.docs)
        keys, null = np.frombuffer(raw, "<i8", self.docs, 8 * self.docs), np.frombuffer(raw, np.uint8, self.docs, 16 * self.docs)
        self.keys = [None if z else int(k) for k, z in zip(keys, null, strict=True)]

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from whole blocks that are as the index says."""
        first, last = start // self.block, -(-stop // self.block)
        full = self.block * self.bits // 8
        data = self.file.read_at(min((last - first) * full, -(-self.ids * self.bits // 8) - first * full), _TRAILER.size + first * full)
        for k in range(first, last):
            if zlib.crc32(memoryview(data)[(k - first) * full : (k - first + 1) * full]) != self.sums[k]:
                raise ValueError(f"block {k} is damaged")
        skip = (start - first * self.block) * self.bits
        return unpack(memoryview(data)[skip // 8 : -(-(skip + (stop - start) * self.bits) // 8)], self.bits, stop - start, skip % 8)

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, leading_space: bool, end_id: int, bits: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq, writer, made = TaskContext.get().partitionId(), 0, None, []
    encode = tokens.encoder(path, leading_space).encode

    def close() -> None:
        docs, ids, size = writer.close()
        made.append((writer.file.name, part, seq, docs, ids, size))

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for at, texts in tokens.blocks(batch.column(1).to_pylist()):
            flat, counts = encode(texts)
            ids = np.insert(flat, np.cumsum(counts), end_id).astype(np.uint32)
            writer = writer or Writer(folder, f"part-{part:05d}-{seq:05d}.lfbp", bits)
            writer.add(keys[at : at + len(texts)], ids, counts + 1)
            if writer.ids >= FILE_IDS or len(writer.keys) >= FILE_DOCS:
                close()
                seq, writer = seq + 1, None
    if writer:
        close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "part", "seq", "docs", "ids", "bytes"])


def bits_of(path: str, end_id: int) -> int:
    """The fewest bits that hold all ids of a vocabulary and the end id."""
    return max(tokens.encoder(path, False).tokenizer.get_vocab_size() - 1, end_id).bit_length()


def write_packed(docs: DataFrame, folder: str, path: str, leading_space: bool, end_id: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all rows in ascending id order; returns the manifest, a row a file with the ids of all files before it."""
    session(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # also rows of one id, or without, are dealt over tasks
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    made = written(rows.mapInArrow(lambda it: _write(it, folder, path, leading_space, end_id, bits), MANIFEST), "packed-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return made.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            reader = Reader(folder, name)
            begins = np.concatenate([[0], reader.ends[:-1]]) if reader.docs else reader.ends
            at = 0
            while at < reader.docs:
                stop = max(at + 1, int(np.searchsorted(reader.ends, begins[at] + (1 << 20), side="right")))
                ids = reader.span(int(begins[at]), int(reader.ends[stop - 1])).astype("<u4")
                view, zero = memoryview(ids.tobytes()), int(begins[at])
                sums = [zlib.crc32(view[4 * (a - zero) : 4 * (b - zero)]) for a, b in zip(begins[at:stop].tolist(), reader.ends[at:stop].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(reader.keys[at:stop], pa.int64()), pa.array(begins[at:stop] + base), pa.array(reader.ends[at:stop] - begins[at:stop]), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
                at = stop


def read_packed(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """A row a document of the files that the manifest names: id, start over all files, n_tokens, ids_crc32."""
    session(manifest)
    files = manifest.select("file", "base").repartition("file")
    return files.mapInArrow(lambda it: _read(it, folder), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def packed_documents(docs: DataFrame, path: str, leading_space: bool, end_id: int, bits: int | None = None) -> DataFrame:
    folder = shared_dir(session(docs), "packed")
    return read_packed(write_packed(docs, folder, path, leading_space, end_id, bits or bits_of(path, end_id)), folder)
