"""WARC archives: write pages, with copies as revisits, and read them back.

Writing: of the pages with equal payloads of at least `least` bytes, the one with the largest id becomes a
response record, and the others revisit it.  A payload travels in chunked transfer framing behind an HTTP head; a
block longer than SEGMENT is cut into a first segment and continuation records.  Archives of about ARCHIVE
bytes are rows of a binary column, in the shared folder, so that Spark alone moves them; segments of one record
may lie in different archives.

Reading: records are parsed by their declared lengths; continuation records are grouped by the origin's id, put
in order by segment number and checked against the total length; chunked framing is decoded, and the payload's
digest verified.  A damaged archive raises WarcError.

Null payloads count as empty; a null url has no target header; a null id has no id header and is never a
response that others revisit, unless none of its group has an id.  Ids are integers; the largest is that by number.  Rows repeated in full each
have a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

SEGMENT = 32 << 10
CHUNK = 4 << 10
ARCHIVE = 4 << 20
#: Groups of copies up to which their table is sent to all executors; beyond it, the join shuffles.
BROADCAST_GROUPS = 20_000


class WarcError(ValueError):
    """A record, segment or chunk that does not hold together."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(data: bytes) -> bytes:
    """The payload of chunked framing, with extensions and trailers left out."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise WarcError("a chunk's size is cut off")
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            raise WarcError("a chunk has no size") from None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise WarcError("a chunk is cut off")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(name: str, page_id: int | None, url: str | None, payload: bytes, refers: int | None) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response in segments."""
    uri = None if url is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m.group()):02X}", url)
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("X-Page-Id", page_id),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"
    if refers is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("X-Refers-To-Page", refers),
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                      ("Content-Type", "application/http;msgtype=response")], head.encode())
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    for k, part in enumerate(parts, 1):
        segment = [] if len(parts) == 1 else [("WARC-Segment-Number", k)]
        if k == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *segment,
                          ("Content-Type", "application/http;msgtype=response")], part)
        else:
            total = ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)
            yield record([("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", own), *segment, total,
                          ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}/{k}')}>")], part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise WarcError(f"no record at {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        at = end + 4 + size + 4
        if data[at - 4 : at] != b"\r\n\r\n":
            raise WarcError("a record's length is wrong")
        yield headers, data[end + 4 : at - 4]


def finish(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a whole record."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no HTTP head")
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    page_id = int(headers["x-page-id"]) if "x-page-id" in headers else None
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    if headers["warc-type"] == "revisit":
        return page_id, int(http["content-length"]), said, "revisit", int(headers["x-refers-to-page"]), None
    payload = unchunk(body) if http.get("transfer-encoding") == "chunked" else body
    if digest(payload) != said:
        raise WarcError("a payload's digest is wrong")
    return page_id, len(payload), said, "response", None, payload


DONE = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
PARSED = pa.schema([*DONE, ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()),
                    ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
DONE_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PARSED_SQL = f"{DONE_SQL}, origin string, segment long, total long, headers map<string,string>, block binary"


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with `refers`: the page that a copy revisits, or null.  Only groups of two
    and more go into the join; their table is counted before it is broadcast."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(
        F.count("*").alias("n"), F.max("page_id").alias("last")
    ).filter("n > 1").select("sha", "last")
    groups = stage(pages.sparkSession, groups, "warc-groups")
    few = len(groups.limit(BROADCAST_GROUPS + 1).select(F.lit(1)).collect()) <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, "sha", "left")
    differs = ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", F.when(differs, F.col("last")).alias("refers"))


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives as rows (archive string, data binary)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        n = size = 0
        made: list[bytes] = []
        count = 0

        def flush():
            nonlocal made, size, n
            out = pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{n:06d}.warc"], "data": [b"".join(made)]},
                                             schema=pa.schema([("archive", pa.string()), ("data", pa.binary())]))
            made, size, n = [], 0, n + 1
            return out

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers")), strict=True):
                count += 1
                for rec in page_records(f"{part}/{count}", page_id.as_py(), url.as_py(), html.as_py().encode(), refers.as_py()):
                    made.append(rec)
                    size += len(rec)
                    if size >= ARCHIVE:
                        yield flush()
        if made:
            yield flush()

    return roles(pages, least).mapInArrow(run, "archive string, data binary")


def read(archives: DataFrame, payloads: bool = False, data_col: str = "data") -> DataFrame:
    """One row for each record of the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and, if asked for, payload (null for revisits)."""
    spark: SparkSession = archives.sparkSession

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for headers, block in parse(data.as_py()):
                    if "warc-segment-number" in headers:
                        first = headers["warc-type"] != "continuation"
                        total = headers.get("warc-segment-total-length")
                        rows.append((None,) * 6 + (headers["warc-record-id" if first else "warc-segment-origin-id"],
                                    int(headers["warc-segment-number"]), int(total) if total else None,
                                    list(headers.items()) if first else None, block))
                    else:
                        done = finish(headers, block)
                        rows.append((*done[:5], done[5] if payloads else None) + (None,) * 5)
                cols = zip(*rows, strict=True) if rows else [()] * len(PARSED)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, PARSED)], schema=PARSED)

    parsed = stage(spark, archives.select(data_col).mapInArrow(run, PARSED_SQL), "warc-records")
    whole = parsed.filter("origin is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")

    def assemble(batches):
        for batch in batches:
            rows = []
            for segments in batch.column(0).to_pylist():
                segments.sort(key=lambda s: s["segment"])
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise WarcError("a segment is missing or repeated")
                block = b"".join(s["block"] for s in segments)
                if segments[-1]["total"] != len(block):
                    raise WarcError("segments don't add up to the total length")
                done = finish(dict(segments[0]["headers"]), block)
                rows.append((*done[:5], done[5] if payloads else None))
            cols = zip(*rows, strict=True) if rows else [()] * len(DONE)
            schema = pa.schema(DONE)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    # a group is one record's block, which came from one row
    groups = parsed.filter("origin is not null").groupBy("origin").agg(
        F.collect_list(F.struct("segment", "total", "headers", "block")).alias("segments"))
    return whole.unionByName(groups.select("segments").mapInArrow(assemble, DONE_SQL))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and give the records without their payloads."""
    archives = stage(pages.sparkSession, write(pages, least=least), "warc-archives")
    return read(archives).drop("payload")
