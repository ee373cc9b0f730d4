"""WARC archives as .warc.zst: one Zstandard frame per record, dictionary in the leading skippable frame.

The writer deals records out to archives; a task writes whole files under the shared folder with a
name of its own attempt and returns their manifest rows, which are themselves stored, so an attempt
that is lost leaves at most an unlisted file. The reader takes the manifest, loads each archive's
dictionary from its first frame, decodes one frame at a time and validates headers and lengths.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from hashlib import sha1

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import join_sized, keep_only
from strandline.session import materialize, scratch_path

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "path string, records long, bytes long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, position long"


def record_name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    if not (name.startswith("<urn:x-page:") and name.endswith(">")):
        raise ValueError(f"record id {name!r}")
    return int(name[12:-1]) if name[12:-1] else None


def _clean(value: str) -> str:
    """A header value is one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One record. A response holds the HTTP header and the payload, a revisit the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += [f"WARC-Block-Digest: sha1:{sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """The record's headers and payload, validated: version, lengths, both digests. Raises ValueError."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes, {size} declared")
    if fields.get("warc-block-digest", "") not in ("", f"sha1:{sha1(block).hexdigest()}"):
        raise ValueError("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    declared = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(declared) != 1:
        raise ValueError(f"{len(declared)} Content-Length lines in the HTTP header")
    declared = declared[0]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != declared or sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {len(payload)} bytes, {declared} declared, or another digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without WARC-Refers-To")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": declared, "payload_digest": digest, "record_type": kind,
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A trained dictionary, or nothing if the samples are too few for one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """A .warc.zst being written to a stream."""

    def __init__(self, out, trained: bytes, level: int = 3):
        self.out = out
        if trained:
            out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_checksum=True)
        self.records, self.bytes = 0, 8 + len(trained) if trained else 0

    def add(self, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.out.write(frame)
        self.records += 1
        self.bytes += len(frame)


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decoded records of an archive, one frame at a time, with the dictionary of its first frame."""
    rest = stream.read(8)
    trained = None
    if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", rest[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError(f"a dictionary of {len(raw)} bytes, {size} declared")
        if raw[:4] == ZSTD_MAGIC:  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        trained, rest = zstandard.ZstdCompressionDict(raw), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    one, parts = None, []
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                break
        if one is None:
            while len(rest) < 4 and (more := stream.read(chunk)):
                rest += more
            if rest[:4] != ZSTD_MAGIC:
                raise ValueError("no Zstandard frame where a record should begin")
            one, parts = unpacker.decompressobj(), []
        parts.append(one.decompress(rest))
        rest = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one = None
    if one is not None:
        raise ValueError("the last frame is cut off")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark itself resolves it, so that archives and tables lie on one file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_archives(records: DataFrame, folder: str, trained: bytes, date: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """records (page_id, url, payload, digest, size, refers_to) -> manifest (path, records, bytes).

    Each task writes its rows in order, to one archive or, beyond archive_bytes, several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _place(folder)
        where.create_dir(base, recursive=True)
        made, archive, out, path = [], None, None, ""
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if archive is None:
                    path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    out = where.open_output_stream(path)
                    archive = Archive(out, trained)
                page_id, url, payload, digest, size, refers_to = (x.as_py() for x in row)
                archive.add(build(page_id, url, payload or b"", digest, size, refers_to, date))
                if archive.bytes >= archive_bytes:
                    out.close()
                    made.append((path, archive.records, archive.bytes))
                    archive = None
        if archive is not None:
            out.close()
            made.append((path, archive.records, archive.bytes))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "records", "bytes"])

    return records.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(run, _MANIFEST)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the listed archives; the number of records is validated against the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _place(folder)
        names = [c.split()[0] for c in _READ.split(", ")]
        types = [pa.string() if c.endswith(" string") else pa.int64() for c in _READ.split(", ")]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                with where.open_input_stream(path, buffer_size=1 << 18) as stream:
                    for raw in frames(stream):
                        try:
                            r = parse(raw)
                        except ValueError as error:
                            raise ValueError(f"{path}, record {n}: {error}") from error
                        rows.append((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], path, n))
                        n += 1
                        if len(rows) == 5000:
                            yield flush(rows)
                            rows = []
                if rows:
                    yield flush(rows)
                if n != records:
                    raise ValueError(f"{path} holds {n} records, {records} listed")

    tasks = max(1, manifest.count())
    return manifest.select("path", "records").repartition(min(tasks, 10_000)).mapInArrow(run, _READ)


def _samples(pages: DataFrame, rows: int, most: int = 20_000) -> list[bytes]:
    """The first most characters of rows pages with the smallest hashed ids: the ids are found first, so a task sends only those."""
    with_html = pages.where(F.col("html").isNotNull())
    ids = with_html.select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id").limit(rows).select(F.col("page_id").alias("__id"))
    picked = with_html.join(F.broadcast(ids.distinct()), F.col("page_id") == F.col("__id"), "left_semi").select("page_id", F.substring("html", 1, most).alias("html"))
    return [r["html"].encode("utf-8", "replace") for r in picked.orderBy("page_id").limit(rows).collect()]


def round_trip(pages: DataFrame, least_bytes: int = 1000, sample_rows: int = 400, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    The payload is the html in UTF-8; null is empty. Of equal payloads of least_bytes or more, the row
    with the largest id is the response and the others revisit it. Smaller payloads, null ids and rows
    that repeat the winner's id are responses. The dictionary is trained on the first 20,000 characters
    of at most sample_rows rows, those with the smallest hashed ids; it changes sizes alone. Other
    columns aren't read. Verdicts are joined without payloads; of these only responses are written, once
    the revisits' keys, where they are few enough, have been broadcast (``keep_only``).
    """
    spark = pages.sparkSession
    folder = qualified(spark, scratch_path(spark, "warc"))
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = base.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    total = base.select("page_id").count()
    large = keyed.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "digest", "size", F.sha2("payload", 256).alias("same"))
    groups = materialize(large.groupBy("same").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "payloads")
    named = join_sized(large, groups, "same", "copies", total, "page_id", "inner")
    revisits = materialize(named.where("page_id < response").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "size", F.col("response").alias("refers_to")), "revisits")
    told = revisits.select("page_id", F.unhex("digest").alias("digest")).distinct()
    responses = keep_only(keyed, {"page_id": F.when(F.col("size") >= least_bytes, F.col("page_id")), "digest": F.unhex("digest")}, told)
    records = responses.withColumn("refers_to", F.lit(None).cast("long")).union(revisits)
    trained = dictionary(_samples(base, sample_rows))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    manifest = materialize(write_archives(records, folder, trained, date), "manifest")
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "position")
