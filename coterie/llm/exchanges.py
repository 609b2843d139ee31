"""Scoring exchanges kept as WARC archives, and captures assembled from them.

An exchange is one call of the scoring service: ``order_id``, ``endpoint`` (the URL that was asked) and
``response_body``. Each becomes three WARC records: a response (or a revisit, when an exchange with a smaller
id already holds the same body), its request and its metadata. Request and metadata name the first record in
``WARC-Concurrent-To``; assembly joins them again into one nested row per capture.

Archives are gzip files written by Spark's text writer: a WARC record ends in an empty line, which is given
as the line separator. The reader splits at the same separator and puts fragments together again by
``Content-Length``, so bodies may hold separators or whole WARC records.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators.components import union_groups
from coterie.sources.scratch import materialise

END = b"\r\n\r\n"
RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, order_id string, endpoint string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"
)
_RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("order_id", pa.string()), ("endpoint", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("fields", pa.map_(pa.string(), pa.string())),
])


def base32_sha1(body: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column: 20 bits are four digits."""
    digest = F.sha1(body)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, uri: Column, headers: list[Column], block: Column) -> Column:
    """Header and block; a null header is left out. The writer's separator ends the record."""
    return F.concat(
        F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers,
                    F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))),
        F.lit("\r\n\r\n"), block)


def write_archive(exchanges: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write ``exchanges(order_id, endpoint, response_body)`` as WARC files under ``path``.

    Of exchanges with equal bodies of at least ``min_revisit_bytes`` bytes the one with the smallest
    ``order_id`` is the response, the others revisit it. A null body is an empty one. Repeated rows stay
    exchanges of their own; if the smallest id is repeated, each of its rows is a response. A null
    ``order_id`` comes after all others and is read back as null; a null ``endpoint`` has no target
    URI. Line breaks in either are percent-encoded. Other columns are not read.

    Only digests that occur twice or more are joined back, so bodies move only if that table is too
    large to broadcast (Spark checks its size); then equal bodies meet in a plain join that adaptive
    execution splits.
    """
    body = F.coalesce(F.col("response_body"), F.lit(""))
    rows = exchanges.select(F.col("order_id").alias("id"), F.col("endpoint").alias("uri"), body.alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body"))).withColumn("size", F.octet_length("body"))
    firsts = materialise(
        rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first-bodies")
    rows = rows.join(firsts, "digest", "left")
    # a null id is never the first one unless all ids of that body are null
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")) & (F.col("size") >= min_revisit_bytes)
    clean = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.select(
        clean(F.col("id")).alias("id"), clean(F.col("uri")).alias("uri"), "digest", "size", revisit.alias("revisit"),
        clean(F.col("first")).alias("first"), "body", F.monotonically_increasing_id().alias("row"))
    urn = lambda part: F.concat(F.lit("<urn:exchange:"), F.col("row").cast("string"), F.lit(f":{part}>"))
    head = [F.lit(f"WARC-Date: {date}"), F.concat(F.lit("Exchange-Order-Id: "), F.col("id"))]
    main = urn("main")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    is_http = F.lit("Content-Type: application/http; msgtype=response")
    response = _record("response", F.col("uri"), [F.concat(F.lit("WARC-Record-ID: "), main), *head, digest, is_http],
                       F.concat(http, F.col("body")))
    again = _record("revisit", F.col("uri"), [
        F.concat(F.lit("WARC-Record-ID: "), main), *head, digest, is_http,
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("Exchange-Refers-To-Order-Id: "), F.col("first"))], http)
    beside = lambda part: [F.concat(F.lit("WARC-Record-ID: "), urn(part)), F.concat(F.lit("WARC-Concurrent-To: "), main), *head]
    request = _record("request", F.col("uri"), [*beside("request"), F.lit("Content-Type: application/http; msgtype=request")],
                      F.lit("POST / HTTP/1.1\r\nAccept: */*\r\n\r\n"))
    metadata = _record("metadata", F.col("uri"), [*beside("metadata"), F.lit("Content-Type: application/warc-fields")],
                       F.concat(F.lit("payload-bytes: "), F.col("size").cast("string"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(F.when(F.col("revisit"), again).otherwise(response), request, metadata)).alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _parse(raw: bytes, with_payload: bool) -> dict:
    """One record from its bytes without the final separator."""
    head, _, block = raw.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers: dict[str, list[str]] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    one = lambda name: headers.get(name, [None])[0]
    kind, digest, size, payload, fields = one("warc-type"), one("warc-payload-digest"), None, None, {}
    if kind in ("response", "request") and (one("content-type") or "").startswith("application/http"):
        payload = block.partition(END)[2]
    elif kind in ("response", "resource"):
        payload = block
    elif kind in ("metadata", "warcinfo"):
        pairs = [x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x]
        fields = {k.strip(): v.strip() for k, _, v in pairs}
    if payload is not None:
        size = len(payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif digest:
        digest = digest.partition(":")[2]
    return {
        "record_id": one("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to", []),
        "order_id": one("exchange-order-id"), "endpoint": one("warc-target-uri"),
        "refers_to": one("exchange-refers-to-order-id"), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if with_payload else None, "fields": list(fields.items()),
    }


def _records(buffer: bytearray, need: list[int]) -> Iterator[bytes]:
    """Take whole records off the buffer's front; need[0] is the length the next one waits for."""
    while len(buffer) >= need[0]:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        at = buffer.find(END)
        if at < 0:
            return
        length = 0
        for line in bytes(buffer[:at]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
        need[0] = at + len(END) + length
        if len(buffer) < need[0]:
            return
        yield bytes(buffer[:need[0]])
        del buffer[:need[0]]
        need[0] = 0


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per WARC record of the gzip archives under ``path`` (columns ``RECORD``).

    Lengths and digests are recomputed from bodies that are there; a revisit has the digest of its
    header. A gzip file is read by one task from front to back, and memory holds one record. A record cut
    off by the end of its file is left out. No files give no rows.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, need, at = bytearray(), [0], None
        for batch in batches:
            out, held = [], 0
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != at:
                    buffer.clear()
                    need[0], at = 0, file
                buffer += piece.as_buffer()
                buffer += END
                for raw in _records(buffer, need):
                    out.append(_parse(raw, with_payload))
                    held += len(raw) if with_payload else 200
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD)

    pieces = spark.read.option("lineSep", END.decode()).text(path)
    return pieces.select(F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(parse, RECORD)


def _along_chains(leads: DataFrame, links: DataFrame) -> DataFrame:
    """``leads(record_id, lead)`` with the lead of records that reach a response over other records only."""
    lost = leads.where("lead is null").select("record_id")
    if lost.isEmpty():
        return leads
    edges = links.join(lost, "record_id", "left_semi").unionByName(links.join(lost.withColumnRenamed("record_id", "target"), "target", "left_semi"))
    parts = materialise(union_groups(edges.select(F.col("record_id").alias("a"), F.col("target").alias("b"))), "chains")
    # without a response, the part goes by the smallest identifier that is named but not there
    reached = parts.join(leads, parts["node"] == leads["record_id"], "left").groupBy("root").agg(
        F.min("lead").alias("reached"), F.min(F.when(F.col("record_id").isNull(), F.col("node"))).alias("named"))
    found = parts.join(reached, "root").select(F.col("node").alias("record_id"), F.coalesce("reached", "named", "root").alias("found"))
    return leads.join(found, "record_id", "left").select("record_id", F.coalesce("lead", "found").alias("lead"))


def assemble_captures(records: DataFrame) -> DataFrame:
    """Join request, response and metadata records into one nested row per capture.

    Request and metadata records belong to the response, revisit or resource record that one of their ``concurrent_to`` identifiers
    names or that names them, else to the one that any chain of such links leads to (of several the smallest id). Output:
    ``capture_id, order_id, endpoint, record_type, refers_to, payload_bytes, payload_digest, payload,
    requests array<struct>, metadata array<struct>, fields map``. Records that lead to none
    form a capture without a response (``record_type`` null). Repeated record ids count as one response; a
    record without an id is a capture of its own.
    Payloads move once, into their row; the rows of a capture are bounded by what an archive says of it.
    """
    anchor = F.col("record_type").isin("response", "revisit", "resource")
    names = F.transform("concurrent_to", lambda x: F.struct(F.col("record_id"), x.alias("target")))
    named = F.transform("concurrent_to", lambda x: F.struct(x.alias("record_id"), F.col("record_id").alias("target")))
    links = materialise(records.where("record_id is not null").select(F.explode(F.when(anchor, named).otherwise(names)).alias("x")).select("x.*"), "concurrent")
    anchors = records.where(anchor & F.col("record_id").isNotNull()).select(F.col("record_id").alias("target"), F.lit(True).alias("is_anchor"))
    leads = materialise(links.join(anchors, "target", "left").groupBy("record_id").agg(
        F.min(F.when(F.col("is_anchor"), F.col("target"))).alias("lead")), "leads")
    leads = _along_chains(leads, links)
    own = F.coalesce("record_id", F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string")))
    keyed = records.withColumn("own", own).join(leads, "record_id", "left").withColumn(
        "capture", F.when(anchor, F.col("own")).otherwise(F.coalesce("lead", "own")))
    part = F.struct("record_id", "payload_bytes", "fields")
    main = F.max(F.when(anchor, F.struct(
        "order_id", "endpoint", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"))).alias("m")
    grouped = keyed.groupBy("capture").agg(
        main,
        F.collect_list(F.when(F.col("record_type") == "request", F.struct("record_id", "payload_bytes"))).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", part)).alias("metadata"))
    fields = F.when(F.size("metadata") > 0, F.col("metadata")[0]["fields"])
    told = fields["payload-bytes"].cast("long")
    return grouped.select(
        F.col("capture").alias("capture_id"), "m.order_id", "m.endpoint", "m.record_type", "m.refers_to",
        F.coalesce(F.col("m.payload_bytes"), told).alias("payload_bytes"), "m.payload_digest", "m.payload",
        "requests", "metadata", fields.alias("fields"))
