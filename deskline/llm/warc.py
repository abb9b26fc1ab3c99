"""WARC archives as a chunked record table (operator 4).

Writing and reading both work on rows of (record, chunk number, chunk): Python holds one batch of
chunks and one gzip state, never a whole payload. Every chunk row carries the SHA-1 of the payload
up to its end, so a record's last row has its whole digest and each row can be checked on its own.

Archives are gzip files with one member a record, written by the tasks into a shared folder. A task
names its files anew in each attempt and reports them in the manifest; readers follow the manifest,
so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import prepare, scratch_path, stored

CHUNK = 64 << 10  # payload bytes of a chunk row
READ = 256 << 10  # compressed bytes read at once
ARCHIVE_BYTES = 1 << 30  # a task begins another archive beyond this size
MIN_REVISIT = 1000  # smaller payloads are always stored
BROADCAST_REVISITS = 1 << 18  # more of them are not broadcast, however small their packed files
DATE = "2024-01-01T00:00:00Z"  # WARC-Date of every record: archives depend on their input only
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:{}>"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url",
                 min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``id``, ``uri``, ``payload`` (binary), ``bytes``, ``digest``, ``type``, ``refers_to`` of every row.

    Of rows with equal payloads of at least ``min_revisit`` bytes the one with the largest id is the
    response and the others revisit it. A null payload is empty. Rows that repeat the largest id are
    all responses; a row with a null id revisits unless its payload's ids are all null.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    own = own.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    narrow = own.select("id", "digest", "bytes").filter(F.col("bytes") >= min_revisit)
    latest = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("rows"))
    latest = latest.filter("rows > 1 AND refers_to IS NOT NULL")
    # Narrow rows meet first, so payloads only move to meet the revisits among them.
    revisits = stored(narrow.select("id", "digest").join(latest, "digest").filter("NOT (id <=> refers_to)")
                      .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct(),
                      "revisits")
    if revisits.count() > BROADCAST_REVISITS:
        revisits = revisits.hint("merge")
    out = own.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
                   & (F.col("bytes") >= min_revisit), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return out.select("id", "uri", "payload", "bytes", "digest", kind.alias("type"), "refers_to")


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each record's payload cut into chunk rows (``chunk_no`` from 0, ``data``); a revisit has one empty one.

    Numbers are generated first and each row cuts its own chunk, so one chunk is held beside the payload, not a
    second copy of it."""
    whole = F.col("type") != "revisit"
    stop = F.when(whole, F.greatest(F.lit(0), F.ceil(F.col("bytes") / chunk) - 1)).otherwise(0)
    numbered = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), stop.cast("int"))))
    data = F.when(whole, F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return numbered.select(F.col("id").cast("string").alias("id"), "uri", "bytes", "digest", "type",
                           F.col("refers_to").cast("string").alias("refers_to"), "chunk_no", data.alias("data"))


def _open(path: str, write: bool):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_stream(inner)


def _head(row) -> bytes:
    """WARC and HTTP header of a record."""
    whole = row.type == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.bytes}\r\n\r\n".encode()
    uri = re.sub(r"[\r\n]+", " ", row.uri).strip() if row.uri else None
    lines = ["WARC/1.1", f"WARC-Type: {row.type}", f"WARC-Record-ID: {RECORD_ID.format(row.id)}", f"WARC-Date: {DATE}",
             *([f"WARC-Target-URI: {uri}"] if uri else []),
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row.digest)).decode()}",
             *([] if whole else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(row.refers_to)}"]),
             "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (row.bytes if whole else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Write the records of ``plan_records`` as ``*.warc.gz`` under ``folder``; the manifest is returned:
    ``path``, ``records``, ``bytes`` (compressed), one row an archive, itself stored in the shared folder."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = packer = None
        done: list[tuple[str, int, int]] = []
        path, n = "", 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk_no == 0:
                    if packer:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    if out and out.tell() >= ARCHIVE_BYTES:
                        done.append((path, n, out.tell()))
                        out.close()
                        out = None
                    if not out:
                        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = _open(path, True)
                    packer, n = zlib.compressobj(1, zlib.DEFLATED, 31), n + 1
                    out.write(packer.compress(_head(row)))
                out.write(packer.compress(row.data))
        if out:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            done.append((path, n, out.tell()))
            out.close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return stored(chunk_rows(records, chunk).mapInPandas(write, "path string, records long, bytes long"), "manifest")


class _Unzipped:
    """Bounded reads from a gzip stream of many members."""

    def __init__(self, stream):
        self.stream, self.raw, self.held, self.unzip = stream, b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Unpack up to READ more bytes into ``held``; False at the end of the file."""
        while True:
            if not self.raw and not (raw := self.stream.read(READ)):
                return False
            self.raw = self.raw or raw
            got = self.unzip.decompress(self.raw, READ)
            self.raw = self.unzip.unconsumed_tail
            if self.unzip.eof:  # after a member of several reads, both names hold what follows it
                self.raw, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark`` (which is passed); None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("archive ends inside a record")
                return None
        got, self.held = self.held[:at], self.held[at + len(mark):]
        return got

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("archive ends inside a record")
        got, self.held = self.held[:n], self.held[n:]
        return got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _records(path: str, chunk: int) -> Iterator[tuple]:
    with _open(path, False) as stream:
        src = _Unzipped(stream)
        while (head := src.until(b"\r\n\r\n")) is not None:
            warc, http_head = _fields(head), src.until(b"\r\n\r\n")
            http = _fields(http_head)
            total = int(warc["content-length"]) - len(http_head) - 4
            ident = [warc["warc-record-id"], warc["warc-type"], warc.get("warc-refers-to"), warc.get("warc-target-uri"),
                     int(http["content-length"]), base64.b32decode(warc["warc-payload-digest"][5:]).hex()]
            digest, at, number = hashlib.sha1(), 0, 0
            while True:
                data = src.take(min(chunk, total - at))
                digest.update(data)
                at += len(data)
                yield (*ident, number, at - len(data), data, digest.hexdigest(), at == total)
                number += 1
                if at == total:
                    break
            if src.take(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")


CHUNKS = ("record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, "
          "payload_digest string, chunk_no int, offset long, data binary, running_digest string, last boolean")


def read_archives(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives named in ``manifest.path``.

    ``payload_bytes`` and ``payload_digest`` are what the headers say of the full payload (of a
    revisit too); ``running_digest`` is the SHA-1 of what was read of the record so far, and ``last``
    marks its final chunk (an empty payload has one empty chunk). A damaged archive raises."""
    prepare(manifest.sparkSession)

    names = CHUNKS.replace(",", "").split()[::2]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, size = [], 0
                for row in _records(path, chunk):
                    rows.append(row)
                    size += len(row[8]) + 500
                    if size >= 64 * CHUNK:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInPandas(read, CHUNKS)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
