"""WARC archives: written by Spark tasks, read back one gzip member at a time.

Writing: payload digests are an expression, the first page of each repeated payload is a
pre-aggregated minimum, and only repeated payloads are joined back. Every task writes archives
of its own under a name no other attempt uses; the manifest of archives is written by Spark,
so only the archives of attempts that succeeded are ever read.

Reading: the archives are dealt out by file. A task reads a file in chunks, inflates each gzip
member incrementally, frames the record by its Content-Length and digests the block as it
comes; memory is one chunk and one record's headers, plus the payload if it is asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm.frames import stored
from spectrafold.session import shared_folder

CHUNK = 1 << 18
ARCHIVE_BYTES = 256 << 20
MIN_REVISIT = 100
MAX_HEAD = 1 << 20  # bytes of a WARC or HTTP head; a longer one is an error, not a buffer that grows
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, digest_ok boolean, error string, record_id string, refers_to_id string"
)


def filesystem(uri: str):
    """pyarrow's file system for a Hadoop-style uri, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def planned(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """Key, url, payload and record type of each page."""
    page = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    )
    first = (
        page.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) & F.col("first_id").isNotNull())
        .drop("copies")
    )
    # Stored first: a join of two plain inputs is one whose hot digests Spark can split.
    first = stored(first, "warc-first")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return page.join(first, "payload_digest", "left").withColumn(
        "refers_to", F.when(again, F.col("first_id"))
    )


def record(row, date: str = DATE) -> bytes:
    """One WARC record as a gzip member of its own."""
    name = "" if pd.isna(row.page_id) else str(int(row.page_id))
    refers = None if pd.isna(row.refers_to) else int(row.refers_to)
    kind = "response" if refers is None else "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row.payload_bytes}\r\n\r\n"
    ).encode()
    block = http if refers is not None else http + row.payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{row.payload_digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if isinstance(row.url, str):
        head.append(f"WARC-Target-URI: {quote(row.url, safe='%')}")
    if refers is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, compresslevel=4, mtime=0)


def write(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
    folder: str | None = None, least: int = MIN_REVISIT,
) -> DataFrame:
    """Write one record per page; returns the manifest (path, records, bytes).

    A null payload is written as an empty one, a null url without a target, a null key with an
    empty name. Of records with equal payloads of at least ``least`` bytes the one with the
    smallest key is a response and the others revisit it; rows that repeat that key as well
    are responses too. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    archives = f"{folder}/archives"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(archives)
        out, done, count = None, 0, 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, done, count = fs.open_output_stream(f"{path}/{name}"), 0, 0
                data = record(row)
                out.write(data)
                done, count = done + len(data), count + 1
                if done >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{archives}/{name}"], "records": [count], "bytes": [done]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{archives}/{name}"], "records": [count], "bytes": [done]})

    manifest = planned(pages, key, url, html, least).mapInPandas(
        run, "path string, records long, bytes long"
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


class Member:
    """Frames one record while its gzip member is inflated."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.left, self.tail = keep, bytearray(), None, 0
        self.fields: dict[str, str] = {}
        self.block, self.payload = hashlib.sha256(), hashlib.sha256()
        self.http, self.in_http, self.size = bytearray(), False, 0
        self.body = bytearray()
        self.error: str | None = None

    def feed(self, data: bytes) -> None:
        if self.error:
            return
        if self.left is None:
            data = self._headed(data)
            if data is None:
                return
        inside, beyond = data[: self.left], data[self.left :]
        self.left -= len(inside)
        self.tail += len(beyond)
        self.block.update(inside)
        if self.in_http:
            inside = self._http_headed(inside)
        self.payload.update(inside)
        self.size += len(inside)
        if self.keep:
            self.body += inside

    def _headed(self, data: bytes) -> bytes | None:
        """What follows the WARC head, once it is complete."""
        seen = max(0, len(self.head) - 3)
        self.head += data
        at = self.head.find(b"\r\n\r\n", seen)
        if at < 0:
            if len(self.head) > MAX_HEAD:
                self.error = "not a WARC header"
            return None
        lines = bytes(self.head[:at]).decode("utf-8", "replace").split("\r\n")
        pairs = (line.partition(":") for line in lines[1:])
        self.fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        self.left = natural(self.fields.get("content-length"))
        if not lines[0].startswith("WARC/") or self.left is None:
            self.error = "not a WARC header"
            return None
        # Only such a block starts with an HTTP head; any other is payload from its first byte.
        self.in_http = self.fields.get("content-type", "").lower().startswith("application/http")
        return bytes(self.head[at + 4 :])

    def _http_headed(self, inside: bytes) -> bytes:
        """What follows the HTTP head; nothing while it is not complete."""
        seen = max(0, len(self.http) - 3)
        self.http += inside
        at = self.http.find(b"\r\n\r\n", seen)
        if at < 0:
            if len(self.http) > MAX_HEAD:
                self.error = "HTTP head does not end"
            return b""
        self.in_http, inside = False, bytes(self.http[at + 4 :])
        del self.http[at:]
        return inside

    def row(self) -> dict:
        if not self.error and (self.left is None or self.left or self.tail != 4):
            self.error = "record and Content-Length differ"
        if not self.error and self.in_http:
            self.error = "HTTP head does not end"
        field = self.fields.get
        kind = field("warc-type")
        own, claimed = self.payload.hexdigest(), field("warc-payload-digest")
        size, digest = self.size, own
        if kind == "revisit":
            # Its payload is that of the record it refers to, as the head states it.
            heads = (x.partition(b":") for x in bytes(self.http).lower().split(b"\r\n"))
            lengths = [v.decode("latin-1") for k, _, v in heads if k.strip() == b"content-length"]
            size = natural(lengths[0]) if lengths else None
            if lengths and size is None:
                self.error = self.error or "Content-Length is no number"
            digest = (claimed or "").removeprefix("sha256:") or None
        ok = self.error is None and matches(field("warc-block-digest"), self.block.hexdigest())
        return {
            "page_id": page_number(field("warc-record-id")),
            "url": field("warc-target-uri"),
            "record_type": kind,
            "payload_bytes": size,
            "payload_digest": digest,
            "refers_to": page_number(field("warc-refers-to")),
            "digest_ok": ok and (kind == "revisit" or matches(claimed, own)),
            "error": self.error,
            "record_id": field("warc-record-id"),
            "refers_to_id": field("warc-refers-to"),
            "payload": bytes(self.body) if self.keep else None,
        }


def natural(text: str | None) -> int | None:
    """A number of at most 18 decimal digits, or None."""
    text = (text or "").strip()
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def page_number(name: str | None) -> int | None:
    """The page a record id of ``write`` names; None for ids of other archives."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,18}|-?[0-9]{19})>", name or "")
    number = int(found[1]) if found else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def matches(claimed: str | None, own: str) -> bool:
    """A digest that is not stated, or not in SHA-256, contradicts nothing; hexadecimal or base 32."""
    kind, _, value = (claimed or "").partition(":")
    if kind.lower() not in ("sha256", "sha-256"):
        return True
    return value.lower() == own or value.upper() == base64.b32encode(bytes.fromhex(own)).decode()


def members(stream, keep: bool = False, chunk: int = CHUNK) -> Iterator[dict]:
    """Records of an open archive in order; a damaged end is reported as a last row."""
    inflate, member, begun = zlib.decompressobj(31), Member(keep), False
    while data := stream.read(chunk):
        while data:
            begun = True
            try:
                member.feed(inflate.decompress(data, chunk))
            except zlib.error as e:
                member.error = f"damaged member: {e}"
                yield member.row()
                return
            data = inflate.unconsumed_tail
            if inflate.eof:
                yield member.row()
                data = inflate.unused_data
                inflate, member, begun = zlib.decompressobj(31), Member(keep), False
    if begun:
        member.error = "archive ends within a member"
        yield member.row()


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives named in column ``path``, one row each, digests verified.

    payload_bytes and payload_digest are of the full payload, for revisits as the record
    states it. Archives of others are read as well: ``page_id`` and ``refers_to`` are null where a record
    id (``record_id``, ``refers_to_id``) is not of the form that ``write`` gives, and the payload of
    a record that is not HTTP is its whole block. ``digest_ok`` is false where block or payload
    differ from a SHA-256 digest of theirs that is stated, or the record has an ``error`` (lengths that
    are no numbers or do not fit, an HTTP head that does not end). A damaged archive gives its records up
    to the damage and one row with ``error``.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                fs, inner = filesystem(path)
                with fs.open_input_stream(inner) as stream:
                    rows, size = [], 0
                    for row in members(stream, payloads):
                        rows.append(row)
                        size += 200 + (len(row["payload"]) if payloads else 0)
                        if size > 8 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _frame(rows, names)

    files = manifest.select("path").dropna()
    return files.repartition(max(1, files.count()), "path").mapInPandas(run, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for name in ("page_id", "payload_bytes", "refers_to"):
        frame[name] = frame[name].astype("Int64")
    return frame


def read_folder(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of a folder that ``write`` filled."""
    return read(spark.read.parquet(f"{folder}/manifest"), payloads)
