"""Archives that others wrote, damaged records, and pages whose payload most rows share."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from spectrafold.llm import warc
from spectrafold.llm.frames import prepare


def member(fields: dict[str, str], block: bytes, version: str = "WARC/1.0") -> bytes:
    head = [version, *[f"{k}: {v}" for k, v in ({"Content-Length": str(len(block))} | fields).items()]]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


UUID = "<urn:uuid:6b2e4b2c-0000-4d1e-9f5e-0123456789ab>"
HTTP = {"Content-Type": "application/http; msgtype=response"}


def read(data: bytes, chunk: int = 7) -> list[dict]:
    return list(warc.members(io.BytesIO(data), True, chunk))


@pytest.mark.parametrize("chunk", [1, 64, 1 << 18])
def test_foreign_records(chunk):
    body = b"<p>page</p>"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    digest = "sha256:" + base64.b32encode(hashlib.sha256(body).digest()).decode()
    info = member({"WARC-Type": "warcinfo", "WARC-Record-ID": UUID, "Content-Type": "application/warc-fields"}, b"a: b")
    page = member({"WARC-Type": "response", "WARC-Record-ID": UUID, "WARC-Payload-Digest": digest} | HTTP, http)
    bare = member({"WARC-Type": "resource"}, b"")
    got = read(info + page + bare, chunk)
    assert [r["error"] for r in got] == [None] * 3 and all(r["digest_ok"] for r in got)
    assert [r["payload"] for r in got] == [b"a: b", body, b""]
    assert [r["payload_bytes"] for r in got] == [4, len(body), 0]
    assert [r["page_id"] for r in got] == [None] * 3
    assert [r["record_id"] for r in got] == [UUID, UUID, None]
    assert [r["payload_digest"] for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"a: b", body, b"")]


def test_wrong_digests_are_found_in_either_notation():
    for value in ("0" * 64, base64.b32encode(bytes(32)).decode()):
        row, = read(member({"WARC-Type": "resource", "WARC-Block-Digest": f"sha256:{value}"}, b"abc"))
        assert row["error"] is None and not row["digest_ok"]
    row, = read(member({"WARC-Type": "resource", "WARC-Block-Digest": "sha1:AAAA"}, b"abc"))
    assert row["digest_ok"]


def test_bad_lengths_and_heads_are_errors_and_the_next_record_is_read():
    revisit = {"WARC-Type": "revisit", "WARC-Refers-To": UUID} | HTTP
    good = member({"WARC-Type": "resource"}, b"x")
    for bad in (
        member({"Content-Length": "many"}, b"x"),
        member({"Content-Length": "²"}, b"x"),
        member({"Content-Length": "9"}, b"x"),
        member({}, b"x", version="HTTP/1.1 200 OK"),
        member(revisit, b"HTTP/1.1 200 OK\r\nContent-Length: long\r\n\r\n"),
        member({"WARC-Type": "response"} | HTTP, b"HTTP/1.1 200 OK\r\nno end"),
    ):
        first, second = read(bad + good)
        assert first["error"] and not first["digest_ok"] and first["refers_to"] is None
        assert second["error"] is None and second["payload"] == b"x"


def test_a_head_without_end_is_not_kept():
    endless = warc.Member(False)
    for _ in range(40):
        endless.feed(b"x" * (1 << 16))
    assert endless.error and len(endless.head) <= warc.MAX_HEAD + (1 << 16)


def test_page_numbers():
    names = {"<urn:page:7>": 7, "<urn:page:-9223372036854775808>": -(1 << 63), "<urn:page:9223372036854775808>": None,
             "<urn:page:>": None, "<urn:page:٣>": None, UUID: None, None: None}
    assert {name: warc.page_number(name) for name in names} == names


def test_a_page_that_most_rows_repeat_and_clashing_columns(spark):
    prepare(spark)
    popular = "p" * 200
    rows = [(k, popular if k % 5 else f"{k} " * 60, "x", "y") for k in range(1, 501)]
    pages = spark.createDataFrame(rows, "page_id long, html string, payload_digest string, first_id string")
    pages = pages.selectExpr("*", "CAST(NULL AS STRING) AS url", "1 AS copies")
    got = {r.page_id: r for r in warc.read(warc.write(pages)).collect()}
    assert len(got) == 500 and all(r.digest_ok and r.error is None for r in got.values())
    for k, html, *_ in rows:
        assert got[k].refers_to == (1 if k % 5 and k > 1 else None)
        assert got[k].payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert got[k].payload_bytes == len(html) and got[k].record_id == f"<urn:page:{k}>"
