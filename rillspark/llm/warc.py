"""WARC archives: a writer with deduplication by payload, and a splittable reader.

A ``.warc.gz`` file is a row of gzip members, one per record, so it can be entered anywhere: a task
takes a byte range, looks for the magic bytes of a member, and believes a place only if what
decodes there begins like a record. It owns the records that start in its range and reads the
last one to its end, past the range. So one large archive is many tasks, and no record is read
twice or lost.

Tasks write and read archives through ``pyarrow.fs``, which opens local, S3, GCS and HDFS
addresses; page tables are read by Spark. A writing task names its archive by a new uuid and
reports it; only reports of finished tasks come into the manifest, so retries leave no doubles.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm.tables import small_batches
from rillspark.session import durable

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 256_000_000
RANGE_BYTES = 8_000_000
MOST_TASKS = 20_000
_CHUNK = 1 << 20
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as tasks on other machines need it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    full = store.makeQualified(place).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def _printable(url: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str
) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, whose length is that of the payload."""
    name = uuid.UUID(bytes=hashlib.md5(f"{page_id}|{url}|{digest}".encode()).digest())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_printable(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    data = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to and revisit.

    Of equal payloads the row of the largest page_id is the response; a null page_id is smaller
    than any. Rows that share that page_id and the payload are one capture and all responses.
    """
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload")).withColumn("_size", F.octet_length("payload"))
    largest = rows.groupBy("_sha1", "_size").agg(F.max("page_id").alias("_first"))
    both = rows.join(largest, ["_sha1", "_size"])
    revisit = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return both.select("page_id", "url", "payload", F.col("_first").alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, date: str = _DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page; returns the manifest: path, length and records of each archive.

    A null html is an empty payload; payloads of 0 bytes are equal like any others.
    """
    spark = pages.sparkSession
    small_batches(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, length, records = None, "", 0, 0

        def report():
            out.close()
            return pa.record_batch({"path": [f"{folder}/{name}"], "length": [length], "records": [records]})

        for batch in batches:
            for row in batch.to_pylist():
                payload = row["payload"]
                member = record(
                    row["page_id"], row["url"], payload, base32_sha1(payload), row["refers_to"], row["revisit"], date
                )
                if out is not None and length + len(member) > archive_bytes:
                    yield report()
                    out = None
                if out is None:
                    name, length, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                length, records = length + len(member), records + 1
        if out is not None:
            yield report()

    return durable(_decided(pages).mapInArrow(write, "path string, length long, records long"))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the archives of a folder; Spark lists them and reads nothing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", "length")


class _Window:
    """A file read forward from an offset, with what has been read and not yet used."""

    def __init__(self, file, offset: int):
        self.file, self.offset, self.data = file, offset, b""
        file.seek(offset)

    def more(self) -> bool:
        part = self.file.read(_CHUNK)
        self.data += part
        return bool(part)

    def drop(self, n: int) -> None:
        self.data, self.offset = self.data[n:], self.offset + n


def _begins_record(window: _Window) -> bool | None:
    """Whether a member whose text begins like a record starts here; None at the end of the file."""
    while True:
        try:
            text = zlib.decompressobj(31).decompress(window.data, 16)
        except zlib.error:
            return False
        if len(text) >= 5:
            return text.startswith(b"WARC/")
        if not window.more():
            return None


def _member(window: _Window) -> bytes | None:
    """Decode the member at the window's start and move behind it; None if it is cut off."""
    unpack, made, size = zlib.decompressobj(31), [], 0
    while True:
        if not window.data and not window.more():
            return None
        made.append(unpack.decompress(window.data))
        size = len(window.data) - len(unpack.unused_data)
        window.drop(size)
        if unpack.eof:
            return b"".join(made)


def records_of_range(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and text of each record that starts in [start, end)."""
    window = _Window(file, start)
    while window.offset < end:
        at = window.data.find(MAGIC)
        if at < 0:
            # Two bytes may be the beginning of the magic.
            window.drop(max(0, len(window.data) - 2))
            if not window.more():
                return
            continue
        window.drop(at)
        if window.offset >= end:
            return
        begins = _begins_record(window)
        if begins is None:
            return
        if not begins:
            window.drop(1)
            continue
        offset = window.offset
        try:
            text = _member(window)
        except zlib.error:
            # A damaged member: go on looking behind its magic.
            window = _Window(file, offset + 1)
            continue
        if text is None:
            return
        yield offset, text


def parsed(text: bytes) -> dict:
    """Headers and payload of a record; payload_bytes and digest are those of the full payload."""
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type")
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n_bytes, digest = int(sizes[0]) if sizes else None, stated
    else:
        n_bytes, digest = len(payload), base32_sha1(payload)
    number = lambda name: int(headers[name]) if headers.get(name, "None") != "None" else None
    return {
        "record_type": kind,
        "page_id": number("x-page-id"),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "intact": digest == stated,
        "refers_to": number("x-refers-to-page-id"),
        "payload": None if kind == "revisit" else payload,
    }


READ = (
    "path string, offset long, record_type string, page_id long, url string, payload_bytes long, "
    "payload_digest string, intact boolean, refers_to long, payload binary"
)


def read_archives(found: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives in ``found`` (path, length).

    ``intact`` says whether the payload has the digest that its header states. A member that
    cannot be decoded is passed over, one that the file cuts off is not a record. An archive kept
    uncompressed inside another archive's record would be read as well.
    """
    tasks = found.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = found.select("path", start.alias("start")).repartition(int(min(tasks, MOST_TASKS)), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = row["path"]
                if path.startswith("file:/") and not path.startswith("file://"):
                    path = "file://" + path[5:]
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for offset, text in records_of_range(file, row["start"], row["start"] + range_bytes):
                        made = parsed(text) | {"path": row["path"], "offset": offset}
                        if not with_payload:
                            made["payload"] = None
                        rows.append(made)
                        held += len(text) if with_payload else 200
                        if held > 16_000_000:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in READ.split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, READ)
