"""Pages as WARC archives: written in id order by many tasks, deterministic to the byte, committed at once, and read back.

``write`` sorts records by id and cuts the sorted list into shards at fixed steps of
its running size; running sums over a range partitioning tell where, whatever its
bounds are. Shards so depend on the records alone, not on tasks, retries or the
cluster. A task writes whole shards, each as one or more ``.warc.gz`` files: every
record is a gzip member of its own, and a new file begins once the last one has its
compressed size. Headers, ids and digests are made anew from the payload.

Files are written under names that no other attempt has. What a task has written it
tells in rows of a manifest, which Spark commits, so that only attempts that count
are in it; then the files named there get their names, and at last the manifest gets
its own. Without a manifest there is no archive, and what a broken run leaves is
never read. Tasks reach files through ``pyarrow.fs``, in any store it knows.

Of records with equal payloads from ``least`` bytes on, that with the largest id is a
``response``; the others are ``revisit`` records that name it, and carry no payload.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import _delete
from . import common

#: Compressed bytes from which on a file is full; bytes of a shard at most, unless ``SHARDS`` of them don't hold all.
FILE, SHARD, SHARDS = 1 << 30, 1 << 28, 10_000
#: Smaller tables are cut into about so many shards, of so many bytes at least.
PARTS, SMALLEST = 256, 1 << 17
#: What a record takes besides its payload.
HEADERS = 700
#: Payloads with copies that are broadcast; beyond that they are joined by shuffle.
BROADCAST = 1_000_000
DATE, PROFILE = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive read at a time.
READ = 1 << 16
END = b"\r\n\r\n"


# ---- records


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _uri(url: str) -> str:
    """``url`` without characters that would end or blur a header."""
    return "".join(c if c > " " and c != "\x7f" else quote(c) for c in url)


def record(kind: str, own_id: str, block: bytes, headers: list[tuple[str, str | None]], content: str, date: str = DATE) -> bytes:
    """A whole record; headers without a value are left out."""
    first = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date)]
    last = [("WARC-Block-Digest", _digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    lines = [f"{k}: {v}" for k, v in [*first, *headers, *last] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END + block + END


def http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}".encode() + END


def page_headers(id_: str | None, url: str | None, digest: bytes) -> list[tuple[str, str | None]]:
    uri = None if url is None else _uri(url)
    return [
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("X-Page-Id", None if id_ is None else quote(id_, safe="")),
        ("X-Page-Url", None if uri == url else quote(url, safe="")),
    ]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record in ``data``; ValueError where it isn't one, or its block isn't the one it was written with."""
    at = 0
    while at < len(data):
        head = data.find(END, at)
        lines = data[at : max(head, at)].decode().split("\r\n")
        if head < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError("this is no WARC record")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        stop = head + 4 + int(headers["content-length"])
        block = data[head + 4 : stop]
        if data[stop : stop + 4] != END or _digest(block) != headers["warc-block-digest"]:
            raise ValueError("a record's block differs from its digest")
        yield headers, block
        at = stop + 4


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of each gzip member in turn; ValueError if the last isn't whole."""
    d, parts = zlib.decompressobj(31), []
    begun = False
    for piece in pieces:
        while piece:
            parts.append(d.decompress(piece))
            begun = True
            if not d.eof:
                break
            yield b"".join(parts)
            piece, d, parts, begun = d.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("an archive ends within a record")


# ---- writing


class _Files:
    """The files that one task attempt writes; a manifest row for each."""

    def __init__(self, store: str, most: int, date: str):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(store)
        self.most, self.date, self.attempt = most, date, uuid.uuid4().hex
        self.rows: list[tuple] = []
        self.shard = self.out = None

    def add(self, shard: int, make) -> None:
        """Appends the record that ``make`` gives for its number in the shard."""
        if shard != self.shard:
            self.close()
            self.shard, self.seq, self.index = shard, 0, 0
        elif self.out and self.bytes >= self.most:
            self.close()
            self.seq += 1
        if not self.out:
            self.name = f"part-{shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha1(usedforsecurity=False)
            info = f"software: brindle\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._put(record("warcinfo", record_id("file", self.name), info, [("WARC-Filename", self.name)], "application/warc-fields", self.date))
        self._put(make(self.index))
        self.index += 1
        self.records += 1

    def _put(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.rows.append((self.name, self.temporary, self.shard, self.seq, self.records, self.bytes, self.sha.hexdigest()))
            self.out = None


MANIFEST = ["file", "temporary", "shard", "seq", "records", "bytes", "sha1"]


def _marked(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with ``shared``, whether its payload has copies, and for all of these but one ``first``: id and url of that one."""
    big = rows.where(F.col("n") >= least)
    top = F.max(F.struct("id", "row", "url")).alias("first")
    copies = common.stage(big.groupBy("digest").agg(F.count("*").alias("n"), top).where("n > 1").select("digest", "first"), "warc-copies")
    if copies.count() <= BROADCAST:
        copies = F.broadcast(copies)
    mine = F.col("first.row") == F.col("row")
    return rows.join(copies, "digest", "left").withColumn("shared", F.col("first").isNotNull()).withColumn("first", F.when(~mine, F.col("first")))


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("place"), F.col("row")]


def _bounds(light: DataFrame, shard_bytes: int | None) -> list[tuple]:
    """The order of the first record of each shard but the first. ``light`` has id, place, row and size; there are ``SHARDS`` shards at most."""
    ranged = common.stage(light.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()), "warc-order")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("all"))
    total = sums.agg(F.sum("all")).first()[0] or 0
    step = shard_bytes or max(SMALLEST, min(SHARD, total // PARTS))
    step = max(step, -(-total // SHARDS))
    # One row for each range partition.
    before = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = ranged.withColumn("inside", inside).join(F.broadcast(before), "part")
    shard = F.floor((F.col("before") + F.col("inside")) / step)
    key = F.struct(F.col("id").isNotNull().alias("has"), "id", "place", "row")
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(key).alias("key")).orderBy("shard").select("key").collect()
    return [tuple(r.key) for r in firsts[1:]]


def _shard_of(bounds: list[tuple]):
    @F.pandas_udf("int")
    def shard(id_: pd.Series, place: pd.Series, row: pd.Series) -> pd.Series:
        keys = zip(id_.notna().tolist(), id_.tolist(), place.tolist(), row.tolist(), strict=True)
        # Null ids are equal to each other here.
        return pd.Series([bisect.bisect_right(plain, (h, i if h else 0, p, r)) for h, i, p, r in keys], dtype="int32")

    plain = [(h, i if h else 0, p, r) for h, i, p, r in bounds]
    return shard


def write(
    pages: DataFrame,
    store: str,
    least: int = 1000,
    file_bytes: int = FILE,
    shard_bytes: int | None = None,
    date: str = DATE,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Writes the archive; ``store`` must not hold one.

    A null html is an empty payload, a null url leaves the header out; characters
    of a url that would break a header are percent-encoded there and kept beside.
    Null ids come first and are smaller than others; rows that share an id are
    ordered by content; of equal rows with equal ids one is the response. No pages
    give a manifest without rows. Other columns are ignored. Ids may be of any
    type that strings can be cast to. A record is held in memory whole; files and
    shards are not.
    """
    spark = pages.sparkSession
    if _exists(spark, f"{store}/manifest"):
        raise ValueError(f"{store} holds an archive")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n": F.length("payload").cast("long"), "row": F.monotonically_increasing_id()})
    # Written, so that a row keeps its number. Equal ids are ordered by content.
    rows = common.stage(rows.withColumn("place", F.xxhash64("url", "digest")), "warc-pages", "zstd")
    marked = _marked(rows, least)
    size = F.lit(HEADERS) + F.coalesce(F.length("url"), F.lit(0)) + F.when(F.col("first").isNull(), F.col("n")).otherwise(0)
    bounds = _bounds(marked.select("id", "place", "row", size.cast("long").alias("size")), shard_bytes)
    shard = _shard_of(bounds)("id", "place", "row") if bounds else F.lit(0)
    cols = [F.col("id").cast("string").alias("name"), "url", "digest", "n", "shared", F.col("first.id").cast("string").alias("of"), F.col("first.url").alias("of_url")]
    again = F.col("first").isNotNull()
    dealt = marked.select("id", "place", "row", shard.alias("shard"), *cols, again.alias("again"), F.when(~again, F.col("payload")).alias("payload"))
    # Python gives the shard before the rows move, and then only writes.
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", *_order()).select("shard", "name", "url", "digest", "n", "shared", "of", "of_url", "again", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(store, file_bytes, date)
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                files.add(r[0], lambda index, r=r: _page(index, *r, date=date))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*files.rows, strict=True) if files.rows else [[]] * 7, TYPES, strict=True)], MANIFEST)

    made = dealt.mapInArrow(run, "file string, temporary string, shard int, seq int, records long, bytes long, sha1 string")
    made.withColumn("id_type", F.lit(pages.schema[id_col].dataType.simpleString())).write.parquet(f"{store}/_manifest")
    _commit(spark, store)


TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]


def _page(index: int, shard: int, id_: str | None, url: str | None, digest: bytes, n: int, shared: bool, of: str | None, of_url: str | None, again: bool, payload: bytes | None, date: str) -> bytes:
    headers = page_headers(id_, url, digest)
    # The one response of a payload with copies is named by that; all others by their place, so equal rows differ.
    own = record_id("payload", digest) if shared and not again else record_id("place", shard, index)
    if not again:
        return record("response", own, http(n) + payload, headers, "application/http; msgtype=response", date)
    headers += [
        ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", record_id("payload", digest)),
        ("WARC-Refers-To-Target-URI", None if of_url is None else _uri(of_url)),
        ("WARC-Refers-To-Date", date),
        ("X-Refers-To-Page-Id", None if of is None else quote(of, safe="")),
    ]
    return record("revisit", own, http(n), headers, "application/http; msgtype=response", date)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _commit(spark: SparkSession, store: str) -> None:
    """Gives the files of a committed manifest their names, then the manifest its own. May be repeated after a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        fs, root = FileSystem.from_uri(store)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{root}/{r['temporary']}").type == FileType.File:
                    fs.move(f"{root}/{r['temporary']}", f"{root}/{r['file']}")
                if fs.get_file_info(f"{root}/{r['file']}").size != r["bytes"]:
                    raise ValueError(f"{r['file']} isn't as it was written")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    made = spark.read.parquet(f"{store}/_manifest")
    made.mapInArrow(run, "n long").agg(F.sum("n")).first()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    _delete(spark, [f"{store}/_temporary"])
    if not fs.rename(path(f"{store}/_manifest"), path(f"{store}/manifest")):
        raise ValueError(f"the manifest of {store} couldn't be committed")


# ---- reading


def read(spark: SparkSession, store: str, payload: bool = True) -> DataFrame:
    """id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, refers_to_record and, if asked for, payload (null for revisits).

    Only files of the manifest are read, each by one task in one stream. Raises
    where a file differs from the manifest in size, digest or number of records,
    a record's block from its digest, or a payload from its length or digest.
    """
    manifest = spark.read.parquet(f"{store}/manifest")
    first = manifest.select("id_type").first()
    kind = first[0] if first else "bigint"

    def pages(file: str, records: int, size: int, sha1: str) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(store)
        sha, total, found = hashlib.sha1(usedforsecurity=False), 0, 0

        def pieces() -> Iterator[bytes]:
            nonlocal total
            with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                while piece := stream.read(READ):
                    sha.update(piece)
                    total += len(piece)
                    yield piece

        for member in members(pieces()):
            for h, block in parse(member):
                if h["warc-type"] in ("response", "revisit"):
                    found += 1
                    yield _read_page(h, block)
        if (found, total, sha.hexdigest()) != (records, size, sha1):
            raise ValueError(f"{file} differs from the manifest")

    names = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "refers_to_record", "payload"][: 8 + payload]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held, size = [], 0
                for page in pages(r["file"], r["records"], r["bytes"], r["sha1"]):
                    held.append(page)
                    size += len(page[8] or b"") if payload else 100
                    if size > 1 << 24:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t, _ in zip(zip(*held, strict=True), types, names, strict=False)], names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "records", "bytes", "sha1").repartition(n, "file")
    rows = files.mapInArrow(run, ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'binary' if c == 'payload' else 'string'}" for c in names))
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")})


def _read_page(h: dict[str, str], block: bytes) -> tuple:
    head = block.find(END)
    length = next(int(line.split(b":")[1]) for line in block[:head].split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:"))
    payload = block[head + 4 :] if h["warc-type"] == "response" else None
    if payload is not None and (len(payload) != length or hashlib.sha1(payload, usedforsecurity=False).digest() != digest):
        raise ValueError("a payload differs from its digest")
    name, of = h.get("x-page-id"), h.get("x-refers-to-page-id")
    url = unquote(h["x-page-url"]) if "x-page-url" in h else h.get("warc-target-uri")
    return (None if name is None else unquote(name), url, h["warc-type"], length, digest.hex(), None if of is None else unquote(of), h["warc-record-id"], h.get("warc-refers-to"), payload)


def verify(records: DataFrame) -> None:
    """ValueError unless record ids are unique and each revisit names a response with its payload's digest and length; ``records`` as from ``read``."""
    twice = records.groupBy("record_id").count().where("count > 1").limit(1).count()
    named = records.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id"), F.col("refers_to").alias("id"), "payload_digest", "payload_bytes").distinct()
    there = records.where("record_type = 'response'").select("record_id", F.col("id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes"))
    lost = named.join(there, "record_id", "left").where(~F.coalesce(same, F.lit(False))).limit(1).count()
    if twice or lost:
        raise ValueError("records repeat an id, or a revisit names no response like it")


def pages(spark: SparkSession, store: str) -> DataFrame:
    """id, url and payload of every record, those of revisits from the responses they name."""
    rows = read(spark, store)
    own = rows.where("record_type = 'response'")
    # Many revisits may name one response: a join, which splits such a key.
    of = own.select(F.col("record_id").alias("refers_to_record"), F.col("payload").alias("__payload"))
    again = rows.where("record_type = 'revisit'").drop("payload").join(of, "refers_to_record")
    return own.select("id", "url", "payload").unionByName(again.select("id", "url", F.col("__payload").alias("payload")))


def op11_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives in the shared folder.

    A null html is an empty payload; a null url has no header; null ids come first;
    of rows with one id and payload one is the response; no pages give no rows;
    other columns are ignored. The archives go with what is staged.
    """
    store = f"{common.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    common.to_discard(store)
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), store)
    rows = common.stage(read(spark, store, payload=False), "warc-records")
    verify(rows)
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), tops AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM tops
"""
