"""WARC archives: writing captures, reading records, assembling transactions.

Writing turns each page into a request, a response (or a revisit, where another
page has an equal payload) and a metadata record that name the response in
WARC-Concurrent-To.  Archives are byte strings of several MB in a table of the
shared folder, so that executors which don't share disks can read them back.

Reading parses archives into one row a record.  Assembly joins the requests and
metadata to their response through the concurrent-to identifiers (directly, or
by way of another record that names the response) and gives one nested row per
capture.

Defined cases: a null payload is an empty one; a null id or address is written
as an empty field and read back as null; repeated rows are captures of their
own; a record that names no known response makes no capture; an archive that is
null, empty or cut off gives the whole records before the damage; of equal
payloads the one with the largest id is the response, and rows that repeat that
id are all responses; a very long payload is one record, read whole; other columns are ignored,
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, utf8

ARCHIVE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of (page, what it refers to) that are broadcast at most, about 40 bytes each.
BROADCAST_ROWS = 200_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key: str) -> str:
    h = hashlib.md5(f"{kind} {key}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _line(text: str | None) -> str:
    """A header value: without what would end its line."""
    return "" if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v != "")
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def capture(key: str, page: str, url: str, payload: bytes, refers: str | None) -> bytes:
    """The three records of one page; ``refers``: the key of the response that a revisit repeats."""
    kind = "response" if refers is None else "revisit"
    own, digest = record_id("capture", key), base32_sha1(payload)
    at = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    path = "/" + url.partition("://")[2].partition("/")[2]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = [] if refers is None else [("WARC-Refers-To", record_id("capture", refers)), ("WARC-Profile", PROFILE)]
    return b"".join((
        record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", key)), ("WARC-Concurrent-To", own), *at, ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {url.partition('://')[2].partition('/')[0]}\r\n\r\n".encode()),
        record([("WARC-Type", kind), ("WARC-Record-ID", own), *at, ("WARC-Payload-Digest", f"sha1:{digest}"), *again, ("Content-Type", "application/http; msgtype=response")], http + (payload if refers is None else b"")),
        record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", key)), ("WARC-Concurrent-To", own), *at, ("Content-Type", "application/warc-fields")], f"page-id: {page}\r\n".encode()),
    ))


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each whole record."""
    at = 0
    while (end := archive.find(b"\r\n\r\n", at)) >= 0:
        first, *lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not first.startswith("WARC/") or not size.isdigit() or end + 4 + int(size) > len(archive):
            return
        yield headers, archive[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size) + 4


def write_archives(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """A written table (archive) of the captures of ``pages`` (page_id, url, html).

    Of pages whose payloads of at least ``revisit_from`` bytes are equal, that
    with the largest page_id is the response and the others revisit it.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = pages.where(F.octet_length("html") >= revisit_from).select("page_id", F.sha2("html", 256).alias("h"))
    several = digests.groupBy("h").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1 and to is not null")
    refers = materialize(digests.join(several, "h").where("page_id is null or page_id <> to").select(F.col("page_id").alias("_p"), F.col("h").alias("_h"), "to").distinct(), "refers")
    few = refers.count() <= BROADCAST_ROWS
    rows = pages.join(F.broadcast(refers) if few else refers, F.col("page_id").eqNullSafe(F.col("_p")) & (F.sha2("html", 256) == F.col("_h")), "left").select("page_id", "url", "html", F.col("to").alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", ARCHIVE_BYTES):
            out = []
            for page, url, payload, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
                page = "" if page is None else str(page)
                out.append(capture(page or hashlib.sha1(payload).hexdigest(), page, _line(url), payload, None if refers is None else str(refers)))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

    return materialize(rows.mapInArrow(run, "archive binary"), "warc")


_RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, verified boolean, page_id long, payload binary"


def read_records(archives: DataFrame, column: str = "archive", payloads: bool = False) -> DataFrame:
    """One row a record of the archives; ``payloads``: with the bodies too.

    payload_bytes and payload_digest are of the full payload: computed from the body
    where the record has it, else as its headers state them.  verified: whether the
    stated digest is that of the body; null without a body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column, 1):
            for archive in b.column(0).to_pylist():
                rows = []
                for h, block in records(archive or b""):
                    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size = verified = page = body = None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = len(body)
                        if kind == "response":
                            found = base32_sha1(body)
                            digest, verified = found, digest in (None, found)
                        else:
                            stated = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            size, body = int(stated[0]) if stated and stated[0].isdigit() else None, None
                    elif kind == "metadata":
                        stated = [x.partition(b":")[2].strip() for x in block.split(b"\r\n") if x.startswith(b"page-id:")]
                        page = int(stated[0]) if stated and stated[0].lstrip(b"-").isdigit() else None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), size, digest, verified, page, body if payloads else None))
                if rows:
                    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary()]
                    names = [x.split()[0] for x in _RECORD.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select(column).mapInArrow(run, _RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture (the response's identifier), response, requests, metadata."""
    part = F.struct("record_id", "type", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "verified", "page_id", "payload")
    main = F.col("type").isin("response", "revisit")
    others = found.where(~main & F.col("concurrent_to").isNotNull()).withColumn("part", part)
    via = others.select(F.col("record_id").alias("_id"), F.col("concurrent_to").alias("_to"))
    others = others.join(via, F.col("concurrent_to") == F.col("_id"), "left").select(F.coalesce("_to", "concurrent_to").alias("capture"), "type", "part")
    # repeated rows write one identifier several times: captures are told apart by its number
    both = found.where(main).select(F.col("record_id").alias("capture"), "type", part.alias("part")).unionByName(others)
    grouped = both.groupBy("capture").agg(*(F.collect_list(F.when(F.col("type").isin(*kinds), F.col("part"))).alias(name) for name, kinds in (("responses", ("response", "revisit")), ("requests", ("request",)), ("metadata", ("metadata",)))))
    nth = F.posexplode("responses").alias("i", "response")
    one = lambda name: F.when(F.size("responses") == F.size(name), F.array(F.col(name)[F.col("i")])).otherwise(F.col(name)).alias(name)
    return grouped.where(F.size("responses") > 0).select("capture", "responses", "requests", "metadata", nth).select("capture", "response", one("requests"), one("metadata"))


def op5_warc_transactions(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all pages, read back from the written archives."""
    found = assemble(read_records(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))))
    found = materialize(found.select("capture", F.col("metadata")[0]["page_id"].alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to")), "captures")
    revisits = found.where("to is not null").select(F.col("to").alias("_to")).distinct()
    known = found.where("record_type = 'response'").join(revisits, F.col("capture") == F.col("_to"), "left_semi").select(F.col("capture").alias("to"), F.col("page_id").alias("refers_to")).distinct()
    return found.join(known, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
h AS (SELECT p.page_id, strlen(p.html) AS n, upper(sha1(p.html)) AS x, g.last FROM p JOIN g USING (html)),
d AS (SELECT page_id, n, last, x, list_transform(range(0, 4), lambda c: ('0x' || substr(x, 10 * c + 1, 10))::BIGINT) AS q FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last OR last IS NULL THEN NULL ELSE last END AS refers_to FROM d
"""
