"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records, and
a footer seek table in the public seekable format (a skippable frame). A record is
found by (bundle, frame, offset in the frame): one footer read, one frame read.

Executors write bundles straight into the shared folder through that folder's file
system under names unique to the attempt; the index they return, committed by Spark,
names the bundles that count, so a lost executor leaves at most unnamed files.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import rowids
from quotemill.llm.scratch import materialize, new_path

# Fixed values of the public Zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 16 << 20
LEAST_SHARED = 1000
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: a response, or a revisit that keeps the headers and leaves the payload out."""
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return CRLF.join(h.encode("utf-8", "surrogatepass") for h in head) + CRLF + CRLF + block + CRLF + CRLF


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record in a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


class BundleWriter:
    """Collects records into frames; ``add`` says where each went, ``close`` gives the file's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self._frame_bytes, self._level = frame_bytes, level
        self._out, self._table = io.BytesIO(), []
        self._open = bytearray()

    def add(self, record: bytes) -> tuple[int, int]:
        if self._open and len(self._open) + len(record) > self._frame_bytes:
            self._flush()
        at = (len(self._table), len(self._open))
        self._open += record
        return at

    def _flush(self) -> None:
        packed = zstandard.ZstdCompressor(level=self._level).compress(bytes(self._open))
        self._table.append((len(packed), len(self._open)))
        self._out.write(packed)
        self._open = bytearray()

    def size(self) -> int:
        return self._out.tell() + len(self._open)

    def close(self) -> bytes:
        if self._open:
            self._flush()
        entries = b"".join(struct.pack("<II", *e) for e in self._table)
        footer = struct.pack("<IBI", len(self._table), 0, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        return self._out.getvalue()


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    raw, out, at = bundle[-9 - n * width : -9], [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    start, packed, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record at an offset of a frame, with no other frame decompressed."""
    _, head, block = next(parse_records(read_frame(bundle, frame)[offset:]))
    return head, block


def _store(path: str, data: bytes) -> None:
    """Write a file in whichever file system the path names; it appears whole or not at all."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{inner}.part") as out:
        out.write(data)
    system.move(f"{inner}.part", inner)


INDEX = "page_id long, no_id boolean, record_type string, bundle string, frame int, offset long, size long"


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to) rows; returns the index (see INDEX), not yet run."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, rows = BundleWriter(), []

        def finish() -> pd.DataFrame:
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            _store(f"{folder}/{name}", writer.close())
            out = pd.DataFrame(rows, columns=["page_id", "no_id", "record_type", "frame", "offset", "size"]).assign(bundle=name)
            return out[["page_id", "no_id", "record_type", "bundle", "frame", "offset", "size"]]

        for df in batches:
            for page_id, no_id, url, payload, digest, keeper, own in zip(df["page_id"], df["no_id"], df["url"], df["payload"], df["digest"], df["keeper"], df["own"]):
                refers_to = None if own else int(keeper)
                record = record_bytes(None if no_id else int(page_id), url, bytes(payload), digest, refers_to)
                rows.append((page_id, no_id, "response" if refers_to is None else "revisit", *writer.add(record), len(record)))
                if writer.size() >= BUNDLE_BYTES:
                    yield finish()
                    writer, rows = BundleWriter(), []
        if rows:
            yield finish()

    sent = records.select(*rowids.apart("page_id"), "url", "payload", "digest", F.coalesce("refers_to", F.lit(0)).alias("keeper"), F.col("refers_to").isNull().alias("own"))
    index = sent.mapInPandas(write, INDEX)
    return index.select(rowids.together("page_id"), *index.columns[2:])


def assign_records(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each page; refers_to is null for responses.

    Of pages with equal payloads of at least ``least_shared`` bytes, that with the
    largest id is the response; every row with that id is. Null html: empty payload.
    Null ids are always responses; rows that share an id are told apart by payload. Equal payloads are told by SHA-256 and length.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("same", F.when(F.length("payload") >= least_shared, F.sha2("payload", 256)))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    keys = keys.where(F.length("payload") >= least_shared).select("page_id", F.sha2("payload", 256).alias("same"))
    shared = materialize(keys.groupBy("same").agg(F.max("page_id").alias("keeper"), F.count("*").alias("k")).where("k > 1").select("same", "keeper"), "payloads")
    refers = materialize(keys.join(shared, "same").where("page_id < keeper").select("page_id", "same", "keeper").distinct(), "revisits")
    return base.join(refers, ["page_id", "same"], "left").select("page_id", "url", "payload", "digest", F.col("keeper").alias("refers_to"))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, read back from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("bundle", F.element_at(F.split("path", "/"), -1)).join(index.select("bundle").distinct(), "bundle", "left_semi")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for bundle in df["content"]:
                for frame in range(len(seek_table(bundle))):
                    rows = []
                    for _, head, block in parse_records(read_frame(bundle, frame)):
                        http, _, payload = block.partition(CRLF + CRLF)
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit:
                            digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
                        intact = hashlib.sha1(block).hexdigest() == head["WARC-Block-Digest"].removeprefix("sha1:") and digest == head["WARC-Payload-Digest"].removeprefix("sha1:")
                        rows.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, length, digest, head["WARC-Type"], int(head["X-Refers-To-Page"]) if revisit else None, head["WARC-Target-URI"], intact))
                    columns = dict(zip([c.split()[0] for c in RECORDS.split(", ")], map(list, zip(*rows))))
                    yield pd.DataFrame(columns | {c: pd.array(columns[c], dtype="Int64") for c in ("page_id", "refers_to")})  # from whole numbers, never through floats

    return files.select("content").mapInPandas(scan, RECORDS)


def archive_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Write all pages; returns (records read back, index, folder). Empty table: no bundles, no rows."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    index = materialize(write_bundles(assign_records(pages), folder), "warc-index")
    return read_bundles(spark, folder, index), index, folder
