"""Web archives (WARC 1.1) written from and read into a chunked record table.

A record is any number of rows (record id, chunk number, bytes), so no task holds a
whole payload besides the cell it came from: ``chunks`` cuts payloads natively,
``write_archives`` streams the rows of its partition into gzip members, one a record,
and ``read_archives`` streams archives back into rows. Every row that is read carries
the length and SHA-1 of its payload up to and including that chunk; with the last chunk
they are those of the whole payload, which must equal the digest in the record's header.

Records with equal payloads of ``min_bytes`` or more are told by SHA-256. The one with
the smallest page id is a response, others are revisits of it (profile
identical-payload-digest): they hold the HTTP header alone, whose Content-Length and the
record's digest describe the full payload.

Scale: payloads are read where they lie. Only the table of payloads that occur more than
once meets them; Spark broadcasts it while it is small, else payloads are dealt by
digest. Payloads with over a thousandth of all rows (so at most a thousand of them) are
always told by broadcast, so that no task gets all copies of one.

Lost executors: a task writes files under names of its own and reports them when it is
done. The manifest, itself written by Spark's committer, names the archives that
count; files of failed attempts stay unnamed and are never read.

Defined results: a null payload is empty; empty payloads are equal like others. A null
page id comes after all ids, and payloads that only rows with null ids have are all
responses. Rows that repeat an id and a payload are alike: all responses or all
revisits, with equal record ids. Addresses are percent-encoded where they hold blanks,
control or non-ASCII characters; a null address has no WARC-Target-URI. An empty table
gives no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Workspace

CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20
#: Rows of a payload from which on it is told by broadcast: this share of all rows, and this many at least.
HOT_SHARE, HOT_ROWS = 1000, 1000
#: Fixed values of the format.
_VERSION, _CRLF = b"WARC/1.1", b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = 1 << 16

CHUNKS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, sha1 binary, chunk_no long, data binary"
MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = "archive string, record_id string, record_type string, target_uri string, page_id long, refers_to_id string, refers_to long, chunk_no long, is_last boolean, payload_bytes long, payload_digest string, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def records(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, record_type, refers_to) of every page."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha1("payload")).alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("digest"))
    counted = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    repeated = work.stage(counted.where("copies > 1 AND first_id IS NOT NULL"), "repeated")
    n = repeated.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]  # a lower bound of all rows: no more than HOT_SHARE payloads exceed their share
    is_hot = F.col("copies") > max(HOT_ROWS, n // HOT_SHARE)
    hot = F.broadcast(repeated.where(is_hot).select("digest", F.col("first_id").alias("hot_first")))
    rows = rows.join(hot, "digest", "left")
    is_copy = F.col("hot_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot_first"))
    rows = rows.withColumn("payload", F.when(~is_copy, F.col("payload")))
    # Hot rows are done: they get a key that meets nothing and spreads them.
    own = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.unhex(F.sha1(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))))
    light = repeated.where(~is_hot).select(F.col("digest").alias("own"), F.col("first_id").alias("light_first"))
    rows = rows.withColumn("own", own).join(light, "own", "left").withColumn("first_id", F.coalesce("hot_first", "light_first"))
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id", "url", F.when(revisits, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "sha1",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """CHUNKS: the chunked record table; every record has a chunk 0, and its chunks follow each other."""
    last = F.greatest(F.ceil(F.octet_length("payload") / size) - 1, F.lit(0))
    cut = rows.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", "payload", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    return cut.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", "chunk_no", F.substring("payload", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("data"))


def record_id(page_id: int | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{sha1.hex()}')}>"


def _address(url: str) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url)


def _head(fields: list[tuple[str, str]]) -> bytes:
    return _CRLF.join([_VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", b""])


def _http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _record_head(row: dict, date: str) -> bytes:
    """Header and HTTP header of a record."""
    http = _http_head(row["payload_bytes"])
    revisit = row["record_type"] == "revisit"
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], row["sha1"])), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _address(row["url"]))] if row["url"] else []
    fields += [("WARC-Payload-Digest", f"sha1:{base32(row['sha1'])}"), ("Content-Type", "application/http; msgtype=response")]
    fields += [("Page-ID", str(row["page_id"]))] if row["page_id"] is not None else []
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["sha1"])), ("Refers-To-Page-ID", str(row["refers_to"]))]
    fields.append(("Content-Length", str(len(http) + (0 if revisit else row["payload_bytes"]))))
    return _head(fields) + http


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system of a folder or file (file, hdfs, s3, gs, abfs) and the path in it."""
    uri = re.sub(r"^file:(//)?(?=/)", "", uri)
    return (pyarrow.fs.LocalFileSystem(), uri) if uri.startswith("/") else pyarrow.fs.FileSystem.from_uri(uri)


class _Archive:
    """One archive being written: a gzip member per record, bytes passed on as they come."""

    def __init__(self, folder: str, date: str):
        self.name, self.n_records, self.n_bytes, self.date = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, date
        store, inner = store_of(self.name)
        self.out = store.open_output_stream(inner, compression=None)
        text = b"software: tabdelta\r\nformat: WARC File Format 1.1\r\n"
        self.begin(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(text)))]) + text)
        self.end()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(wbits=31)
        self.add(head)

    def add(self, data: bytes) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.compress(_CRLF * 2) + self.member.flush())

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.n_records, self.n_bytes


def _written(batches: Iterator[pa.RecordBatch], folder: str, date: str, archive_bytes: int) -> Iterator[tuple[str, int, int]]:
    """Writes the rows of a partition; gives the archives as they are closed."""
    archive, left, sha1, want = None, 0, None, b""

    def finish() -> None:
        if left or sha1.digest() != want:
            raise ValueError("the chunks of a record don't make up its payload")
        archive.end()
        archive.n_records += 1

    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk_no"] == 0:
                if archive is not None:
                    finish()
                    if archive.n_bytes >= archive_bytes:
                        yield archive.close()
                        archive = None
                archive = archive or _Archive(folder, date)
                archive.begin(_record_head(row, date))
                revisit = row["record_type"] == "revisit"
                left, sha1, want = 0 if revisit else row["payload_bytes"], hashlib.sha1(), hashlib.sha1().digest() if revisit else row["sha1"]
            archive.add(row["data"])
            sha1.update(row["data"])
            left -= len(row["data"])
    if archive is not None:
        finish()
        yield archive.close()


def write_archives(table: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a chunked record table below ``folder``, which all machines share; returns the manifest, already written.

    ``date``: the WARC-Date of all records. A record's chunks lie together and in order, as chunks() gives them.
    """
    schema = table.sparkSession.createDataFrame([], MANIFEST).schema

    def run(batches):
        store, inner = store_of(folder)
        store.create_dir(inner, recursive=True)
        for name, n_records, n_bytes in _written(batches, folder, date, archive_bytes):
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n_records], "n_bytes": [n_bytes]})

    path = f"{folder}/manifest"
    table.mapInArrow(run, schema).write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(schema).parquet(path)


def _fields(source) -> dict[str, str]:
    """Header fields up to the blank line, names in lower case."""
    out, name = {}, None
    while (line := source.readline(_LINE)) not in (_CRLF, b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if name and text[:1] in (" ", "\t"):
            out[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _http_fields(source, size: int) -> tuple[dict[str, str], int]:
    """Fields of an HTTP header inside a block of ``size`` bytes, and the bytes of the block that are left."""
    out = {}
    while size > 0 and (line := source.readline(min(_LINE, size))):
        size -= len(line)
        if line in (_CRLF, b"\n"):
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out, size


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?[0-9]+", text) else None


def parse(source, archive: str, size: int = CHUNK, data: bool = True) -> Iterator[tuple]:
    """RECORDS of an archive opened for reading; damaged records are errors."""
    while line := source.readline(_LINE):
        if line in (_CRLF, b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record where one should begin")
        head = _fields(source)
        kind, left = head.get("warc-type", ""), int(head["content-length"])
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        http = {}
        if head.get("content-type", "").startswith("application/http"):
            http, left = _http_fields(source, left)
        facts = (archive, head.get("warc-record-id"), kind, head.get("warc-target-uri"), _number(head.get("page-id")), head.get("warc-refers-to"), _number(head.get("refers-to-page-id")))
        if kind == "warcinfo" or kind == "revisit":
            while left > 0 and (piece := source.read(min(size, left))):
                left -= len(piece)
            if kind == "revisit":
                yield (*facts, 0, True, _number(http.get("content-length")), digest, None)
            continue
        sha1, done, k = hashlib.sha1(), 0, 0
        while True:
            piece, want = b"", min(size, left)
            while len(piece) < want:
                more = source.read(want - len(piece))
                if not more:
                    raise ValueError(f"{archive}: a record ends early")
                piece += more
            left -= len(piece)
            done += len(piece)
            sha1.update(piece)
            now = base32(sha1.digest())
            if left == 0 and digest is not None and digest != now:
                raise ValueError(f"{archive}: the payload of {facts[1]} doesn't have its digest")
            yield (*facts, k, left == 0, done, now, piece if data else None)
            k += 1
            if left == 0:
                break


def read_archives(spark: SparkSession, manifest: DataFrame, size: int = CHUNK, data: bool = True) -> DataFrame:
    """RECORDS of all archives of a manifest; without ``data`` payloads stay where they are read."""
    schema = spark.createDataFrame([], RECORDS).schema
    arrow = pa.schema([pa.field(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                store, inner = store_of(name)
                with store.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as source:
                    rows, held = [], 0
                    for row in parse(source, name, size, data):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held >= 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    got = manifest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    tasks = min(got.n, max(spark.sparkContext.defaultParallelism, got.b // ARCHIVE_BYTES + 1))  # archives are read by one task each
    return manifest.select("archive").repartition(max(1, tasks)).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, folder: str | None = None, size: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as archives and returns their manifest; ``folder`` by default a scratch folder of the session."""
    work = Workspace(pages.sparkSession, "warc")
    return write_archives(chunks(records(pages, work, id_col, url_col, payload_col, min_bytes), size), folder or f"{work.root}/archives", archive_bytes=archive_bytes)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from its record."""
    back = read_archives(pages.sparkSession, archive_pages(pages, **options), options.get("size", CHUNK), data=False)
    return back.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
