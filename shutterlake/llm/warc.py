"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC 1.1 records, followed by a seek table in a skippable
frame (the public seekable format), so that any reader of Zstandard reads it and a reader of the table gets one frame without
the rest. The index, a table, maps record ids to bundle, frame and the offset inside the frame.

Of rows with equal payloads the one with the smallest id is stored as a response; the others become revisit records that name
it. Payloads are told apart by their sha256; only ids and digests are shuffled to find the repeated ones, and where that table
is small, as Spark measures it, the pages are not moved at all.

Files are written by the tasks through pyarrow's file systems into a folder that the cluster shares; every attempt of a task
writes files of its own name, and the index, committed by Spark, names those that count. What a lost attempt leaves behind is
named nowhere.

Defined results: a null payload is an empty one; payloads below min_bytes are responses all; a null id comes last among equal
payloads, and its record has no id; rows that repeat id, url and payload are responses each, under one record id; a null url
leaves out the target header; control characters and spaces in a url are percent-encoded; an empty table gives an empty index.
Other columns may have any name. A payload is held in memory whole, once, with its frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .common import small_batches, table, written

#: Fixed values of the public formats: magic numbers of a skippable frame and of a seek table; the profile of a revisit.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, id long, type string, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"
RECORD = "record_id string, id long, type string, url string, refers_to string, payload_bytes long, payload_digest string"
#: Bytes of compressed frames that a task reads.
READ_BYTES = 64 << 20


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path)


class Bundle:
    """A bundle being written. add() returns where the record begins in the open frame; frames that are full go out."""

    def __init__(self, folder: str, level: int, frame_bytes: int) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, name = _store(self.path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.level, self.most = store.open_output_stream(name, compression=None), level, frame_bytes
        self.open, self.size, self.at, self.frames, self.waiting = [], 0, 0, [], []

    def add(self, record: bytes, row: tuple) -> list[tuple]:
        """The index rows of the frame that this record has filled, if it has."""
        self.waiting.append((*row, self.size, len(record)))
        self.open.append(record)
        self.size += len(record)
        return self.flush() if self.size >= self.most else []

    def flush(self) -> list[tuple]:
        if not self.open:
            return []
        plain = b"".join(self.open)
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(plain)
        self.out.write(packed)
        rows = [(*row, self.path, len(self.frames), self.at, len(packed), at, n) for *row, at, n in self.waiting]
        self.frames.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.at += len(packed)
        self.open, self.size, self.waiting = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE))
        self.out.close()
        return rows


def seek_table(file) -> list[tuple[int, int, int, int]]:
    """(offset, compressed bytes, plain bytes, checksum) per frame, read from the end of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 12 * n)
    out, at = [], 0
    for packed, plain, check in struct.iter_unpack("<III", file.read(12 * n)):
        out.append((at, packed, plain, check))
        at += packed
    return out


def _frame(file, entry: tuple[int, int, int, int]) -> bytes:
    at, packed, plain, check = entry
    file.seek(at)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed))  # its header has the plain size
    if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame's checksum does not fit")
    return data


def _uri(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(kind: str, digest: str, page: int | None, url: str | None) -> str:
    """The same for the same record, so that a revisit can name a response that another task writes."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((kind, digest, page, url)).encode()).digest()[:16], version=5)}"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None]
    return b"".join((b"WARC/1.1\r\n", "".join(lines).encode(), b"\r\n", block, b"\r\n\r\n"))


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, first: tuple[int | None, str | None] | None, date: str) -> tuple[str, str, bytes]:
    """(record id, type, record). first: id and url of the response, if this is a revisit. The block is an HTTP response, without its body in a revisit."""
    kind = "revisit" if first else "response"
    name = record_id(kind, digest, page, url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _uri(url)), ("WARC-Page-ID", None if page is None else str(page))]
    headers += [("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}")]
    if first:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{record_id('response', digest, *first)}>"), ("WARC-Refers-To-Target-URI", None if first[1] is None else _uri(first[1]))]
    return name, kind, _record([*headers, ("Content-Type", "application/http; msgtype=response")], block)


def parsed(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of the records of a frame, from an offset on. Names of headers are in lower case."""
    view = memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        n = int(headers["content-length"])
        yield headers, view[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _read(headers: dict[str, str], block: memoryview) -> tuple:
    """A row of RECORD and the payload. A response's digest is taken from the payload and held against its header."""
    data = bytes(block)
    body = data[data.index(b"\r\n\r\n") + 4 :]
    said, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if sha1(data) != headers["warc-block-digest"].removeprefix("sha1:") or kind == "response" and sha1(body) != said:
        raise ValueError(f"the digest of {headers['warc-record-id']} does not fit")
    page, refers = headers.get("warc-page-id"), headers.get("warc-refers-to")
    row = (headers["warc-record-id"].strip("<>"), None if page is None else int(page), kind, headers.get("warc-target-uri"), refers and refers.strip("<>"), len(body) if kind == "response" else None, said)
    return row, body


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages as bundles below folder; the index (INDEX), a written table. date: of the capture, as no column has it."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("url"))
    facts = rows.where(F.octet_length("payload") >= min_bytes).select("digest", place.alias("place"))
    repeated = facts.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated.select(F.col("digest").alias("same"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-repeated")
    joined = rows.join(repeated, F.col("digest") == F.col("same"), "left")
    joined = joined.withColumn("revisit", F.col("same").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")) | F.col("same").isNotNull() & ~F.col("url").eqNullSafe(F.col("first_url"))).drop("same")
    schema = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, full = None, []
        for b in batches:
            columns = [b.column(c) for c in ("id", "url", "payload", "digest", "revisit", "first_id", "first_url")]
            columns[2] = columns[2].cast(pa.binary())
            for i in range(b.num_rows):
                page, link, body, digest, again, first_id, first_url = (c[i].as_py() for c in columns)
                if bundle is None:
                    bundle = Bundle(folder, level, frame_bytes)
                name, kind, record = page_record(page, link, body, digest, (first_id, first_url) if again else None, date)
                full += bundle.add(record, (name, page, kind))
                if bundle.at >= bundle_bytes:
                    full, bundle = full + bundle.close(), None
            if full:
                yield _batch(full, schema)
                full = []
        if bundle is not None and (full := bundle.close()):
            yield _batch(full, schema)

    return written(joined.mapInArrow(run, INDEX), "warc-index")


def scan(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the bundles that an index names (RECORD, with `payload` if asked for): frames are found by the seek tables and read in parallel."""
    spark, ddl = index.sparkSession, RECORD + ", payload binary" * payloads
    schema = _schema(ddl)
    bundles = index.groupBy("bundle").agg(F.max(F.col("frame_at") + F.col("frame_bytes")).alias("bytes"), F.max("frame").alias("last"))
    total = bundles.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    blocks = bundles.select("bundle", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(16))).alias("start"))
    tasks = max(min(spark.sparkContext.defaultParallelism, total.n), -(-(total.bytes or 0) // READ_BYTES), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, start in zip(b.column("bundle").to_pylist(), b.column("start").to_pylist(), strict=True):
                store, name = _store(bundle)
                with store.open_input_file(name) as file:
                    for entry in seek_table(file)[start : start + 16]:
                        found = (_read(*record) for record in parsed(_frame(file, entry)))
                        yield _batch([(*row, body) if payloads else row for row, body in found], schema)

    return blocks.repartition(tasks).mapInArrow(run, ddl)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of wanted (record_id), with payload: only their frames are read. A revisit's payload is null; follow() has it."""
    ddl = RECORD + ", payload binary"
    schema = _schema(ddl)
    found = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame_at", "frame_bytes", "at", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, b""
        for b in batches:
            for r in b.to_pylist():
                if last != (r["bundle"], r["frame_at"]):
                    last = r["bundle"], r["frame_at"]
                    store, name = _store(r["bundle"])
                    with store.open_input_file(name) as file:
                        file.seek(r["frame_at"])
                        data = zstandard.ZstdDecompressor().decompress(file.read(r["frame_bytes"]))
                row, body = _read(*next(parsed(data, r["at"])))
                yield _batch([(*row, body if row[2] == "response" else None)], schema)

    return found.repartition("bundle", "frame_at").sortWithinPartitions("bundle", "frame_at", "at").mapInArrow(run, ddl)


def follow(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, id, url, payload) of wanted (record_id): revisits have the payload of the response they name."""
    got = written(fetch(index, wanted), "warc-fetched")
    there = got.where("type = 'response'").select("record_id", "id", "url", "payload")
    again = got.where("type = 'revisit'").select("record_id", "id", "url", "refers_to")
    firsts = written(fetch(index, again.select(F.col("refers_to").alias("record_id"))).dropDuplicates(["record_id"]).select(F.col("record_id").alias("first"), "payload"), "warc-fetched")
    return there.unionByName(again.join(firsts, F.col("refers_to") == F.col("first")).select("record_id", "id", "url", "payload"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, and what the archives say of each."""
    index = archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    rows = written(scan(index), "warc-records")
    again = rows.where("type = 'revisit'")
    named = again.select(F.col("refers_to").alias("record_id")).distinct()
    firsts = rows.where("type = 'response'").join(named, "record_id", "left_semi").dropDuplicates(["record_id"])
    firsts = written(firsts.select(F.col("record_id").alias("first"), F.col("id").alias("first_id"), F.col("payload_bytes").alias("first_bytes")), "warc-firsts")
    again = again.join(firsts, F.col("refers_to") == F.col("first"))
    report = lambda df, n, to: df.select(F.col("id").alias("page_id"), F.col(n).alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), to.alias("refers_to"))
    return report(rows.where("type = 'response'"), "payload_bytes", F.lit(None).cast("long")).unionByName(report(again, "first_bytes", F.col("first_id")))
