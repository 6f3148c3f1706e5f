"""Deterministic sharded WARC writer and reader.

Records are range-partitioned by page id, and by content where one id has many, into shards of about equal payload whose bounds
follow from the table alone, sorted, and written one gzip member a record; a file is rolled when its compressed size reaches ``FILE_BYTES``. Which record
revisits which is decided on ids, digests and lengths alone; the decisions travel with the payloads, which are shuffled once. Equal rows that are more than
a shard travel as one row with its count for each shard that they fill. Headers
are made anew: record ids and digests follow from the content and dates are a parameter, so the same table gives
the same bytes on any cluster. Files get temporary names first, then theirs; a manifest table with each file's size
and digest is the commit, and readers open what it names and nothing else.

Of records with equal payloads of at least ``REVISIT_BYTES``, that of the smallest page id is a response and the
others are revisits that name it. The full payload's digest and length stand in the headers of both.

Defined results: a null html is an empty payload; rows with a null page id are written first and refer to others but
are named by none unless all ids of their payload are null (then all are responses); repeated rows of the naming id are
all responses; a null url has no target header; extra columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .common import session, shared_dir, written

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
#: Payload bytes a shard is to have.
SHARD_BYTES = 256 << 20
#: Shards at most, as their bounds go to every task; beyond, shards get larger.
MOST_SHARDS = 1 << 16
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, n, key, place): records go by key and place, which follow from id, content and url."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n": F.octet_length("html").cast("long")})
    place = F.conv(F.substring(F.sha2(F.concat("digest", F.coalesce("url", F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    return rows.withColumns({"key": F.coalesce("page_id", F.lit(-(2**63))), "place": place})


def _revisits(narrow: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of rows whose payload an earlier id has. ``narrow`` has no payloads."""
    firsts = narrow.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("times").alias("c")).where("c > 1 AND first IS NOT NULL").select("digest", "first")
    return narrow.join(firsts, "digest").where(~F.col("first").eqNullSafe(F.col("page_id"))).select("key", "place", "page_id", "digest", F.col("first").alias("refers_to"))


def sharded(pages: DataFrame, id_col: str, url_col: str, html_col: str, shard_bytes: int = SHARD_BYTES, most_shards: int = MOST_SHARDS) -> tuple[DataFrame, int]:
    """(shard, page_id, place, kind, url, html, digest, refers_to, times): payloads (kind 1) and, before them, decisions on them (kind 0); and the number of shards.

    Running sums of the payloads in the order of records are cut at multiples of ``shard_bytes``, or of more where there would be
    over ``most_shards`` shards. They come from sums of sorted partitions, so they don't depend on how Spark has dealt
    these. The first key of each shard is a bound, the only thing that leaves the executors. Equal rows that lie on both sides of a cut are
    as few groups as there are cuts.
    """
    rows = _rows(pages, id_col, url_col, html_col)
    # ids, digests and lengths: all decisions are made on these
    groups = ["key", "place", "page_id", "url", "digest", "n"]
    narrow = written(rows.groupBy(*groups).agg(F.count("*").alias("times")), "warc-narrow")
    total = narrow.agg(F.sum((F.col("n") + 512) * F.col("times"))).first()[0] or 0
    size = max(shard_bytes, -(-total // most_shards))
    sums = narrow.withColumn("bytes", (F.col("n") + 512) * F.col("times")).repartitionByRange("key", "place", "url").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("key", "place", "url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = written(sums.withColumn("end", F.sum("bytes").over(within)), "warc-sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    begins = sums.groupBy("part").agg(F.max("end").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin"))
    placed = sums.join(F.broadcast(begins), "part").withColumn("start", F.expr("begin + end - bytes"))
    placed = placed.withColumns({"cell": F.expr(f"start div {size}"), "last": F.expr(f"(start + (times - 1) * (n + 512)) div {size}")})
    bounds = placed.groupBy("cell").agg(F.min(F.struct("key", "place")).alias("m")).select("m.key", "m.place", "cell").orderBy("key", "place").toPandas()  # a row a shard, at most ``most_shards``
    shard = _shards(bounds["key"].to_numpy(np.int64), bounds["place"].to_numpy(np.int64), bounds["cell"].to_numpy(np.int64))(F.col("key"), F.col("place")).alias("shard")
    spread = written(placed.where("last > cell"), "warc-spread")  # at most one for each cut
    same = ["key", "place", "page_id", "url"]
    wide = spread.select(*[F.col(c).alias(f"_{c}") for c in same])
    is_spread = (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place")) & F.col("page_id").eqNullSafe(F.col("_page_id")) & F.col("url").eqNullSafe(F.col("_url"))
    once = rows.join(F.broadcast(wide), is_spread, "left_anti").select(shard, "page_id", "place", F.lit(1).alias("kind"), "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(1).cast("long").alias("times"))
    upto = lambda cell: F.greatest(F.lit(0), F.least(F.col("times"), F.expr(f"(({cell}) * {size} - start + n + 511) div (n + 512)")))  # noqa: E731  rows that begin before a cut
    split = spread.withColumn("shard", F.explode(F.sequence("cell", "last"))).withColumn("times", upto("shard + 1") - upto("shard")).where("times > 0")
    one = rows.join(F.broadcast(wide), is_spread, "left_semi").groupBy("key", "place", "page_id", "url", "digest").agg(F.min("html").alias("html"))
    many = split.join(one.withColumnsRenamed({"page_id": "_p", "url": "_u"}), ["key", "place", "digest"]).where(F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")))
    many = many.select(F.col("shard").cast("int").alias("shard"), "page_id", "place", F.lit(1).alias("kind"), "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"), "times")
    decided = _revisits(narrow)
    none = F.lit(None).cast("string")
    told = decided.select(shard, "page_id", "place", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "digest", "refers_to", F.lit(1).cast("long").alias("times"))
    again = decided.join(F.broadcast(wide.select(F.col("_key").alias("key"), F.col("_place").alias("place")).distinct()), ["key", "place"], "left_semi")
    again = again.join(spread.select("key", "place", F.explode(F.sequence("cell", "last")).alias("shard")), ["key", "place"]).select(F.col("shard").cast("int").alias("shard"), "page_id", "place", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "digest", "refers_to", F.lit(1).cast("long").alias("times"))
    return once.unionByName(many).unionByName(told).unionByName(again), max(1, -(-total // size))


def _shards(keys: np.ndarray, places: np.ndarray, cells: np.ndarray):
    """A function of key and place: the cell of the last of the sorted bounds that isn't after them."""

    @F.pandas_udf("int")
    def shard(key: pd.Series, place: pd.Series) -> pd.Series:
        k, p = key.to_numpy(np.int64), place.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
        out = high - 1
        for i in np.flatnonzero(high - low > 0):  # ids at which a shard begins
            out[i] = low[i] + np.searchsorted(places[low[i] : high[i]], p[i], side="right") - 1
        return pd.Series(cells[np.maximum(out, 0)] if len(cells) else out)

    return shard


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    def name(key: int | None, what: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{what}:{key}:{digest}')}>"

    revisit = refers_to is not None
    head = ["WARC/1.1", "WARC-Type: " + ("revisit" if revisit else "response"), "WARC-Record-ID: " + name(page_id, "record"), f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    block = b"" if revisit else html
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To: " + name(refers_to, "record"), f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(html)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest() if revisit else digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time stamp
    return packer.compress(data) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    made: list[tuple] = []
    file = seen = shard = decision = None
    seq = records = 0
    ends: list[int | None] = []

    def close() -> None:
        file.commit()
        made.append((file.name, records, file.size, seen.hexdigest(), ends[0], ends[1]))

    for batch in batches:
        for row in (x for r in batch.to_pylist() for x in [r] * r["times"]):
            if row["kind"] == 0:
                decision = (row["page_id"], row["digest"], row["refers_to"])
                continue
            refers_to = decision[2] if decision and decision[:2] == (row["page_id"], row["digest"]) else None
            if file and (row["shard"] != shard or file.size >= file_bytes):
                close()
                file, seq = None, seq + 1 if row["shard"] == shard else 0
            if not file:
                shard, records, seen, ends = row["shard"], 0, hashlib.sha256(), [row["page_id"], None]
                file = store.Committed(folder, f"shard-{shard:05d}-{seq:05d}.warc.gz")
                info = b"software: ledgerflow\r\nformat: WARC file version 1.1\r\n"
                head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file.name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {file.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                data = _member(head.encode() + info + b"\r\n\r\n")
                file.write(data)
                seen.update(data)
            data = _member(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], refers_to, date))
            file.write(data)
            seen.update(data)
            records, ends[1] = records + 1, row["page_id"]
    if file:
        close()
    if made:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> DataFrame:
    """Writes all rows; returns the manifest, a row a file."""
    session(pages)
    rows, shards = sharded(pages, id_col, url_col, html_col, shard_bytes)
    # the order of keys and places, within which decisions go before payloads
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "place", "digest", "kind", "url")
    return written(rows.select("shard", "page_id", "url", "html", "digest", "refers_to", "kind", "times").mapInArrow(lambda it: _write(it, folder, file_bytes, date), MANIFEST), "warc-manifest")


def records_of(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a file of gzip members, one at a time."""
    unpacker, held, raw, ended = zlib.decompressobj(31), bytearray(), b"", False
    while True:
        raw = raw or stream.read(chunk)
        if not raw:
            if held:
                raise ValueError("an archive ends within a record")
            return
        held += unpacker.decompress(raw)
        ended, raw = unpacker.eof, unpacker.unused_data if unpacker.eof else b""
        if ended:
            data, held, unpacker = bytes(held), bytearray(), zlib.decompressobj(31)
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            if rest[n:] != b"\r\n\r\n":
                raise ValueError(f"a record of {lines[0]} has a wrong length")
            yield fields, rest[:n]


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = store.place(folder)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for name in batch.column("file").to_pylist():
            rows = []
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for fields, block in records_of(stream):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                    if kind == "response":
                        digest, n = hashlib.sha256(block).hexdigest(), len(block)  # from what was read, not from what it says
                    key, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((None if key is None else int(key), n, digest, kind, None if to is None else int(to)))
                    if len(rows) == 4096:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row a record of the files that the manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    session(manifest)
    return manifest.select("file").repartition("file").mapInArrow(lambda it: _read(it, folder), RECORD)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    folder = shared_dir(session(pages), "warc")
    return read_archives(write_archives(pages, folder, id_col, url_col, html_col, file_bytes, shard_bytes), folder)
