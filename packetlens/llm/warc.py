"""WARC archives with segmented records, written and read with Spark.

Writing: one record per page. The block is an HTTP response with its body in
chunked transfer framing; a block longer than ``segment_bytes`` is split into a
first record and continuations that carry the origin's id, their segment number
and, on the last, the total length. Of pages with equal payloads of at least
``min_revisit`` bytes the one with the largest id is stored and the others are
revisit records that refer to it. Files are written with Spark's text writer
(the record end is its line end), so commit and retry are Spark's.

Reading: every file's records; continuations are grouped by origin, ordered by
segment number and joined; the total length and the payload's digest are
verified (a mismatch raises); chunk framing is decoded; revisits are resolved
against the record they refer to.

A file holds at most ``records_per_file`` records, a group one page's segments.

Defined results: null html is an empty payload; a null url leaves the target
out; a null page id is written as such and read back as null; repeated rows are
records with one id and come back as often as they were written; an empty table
gives an empty archive and no pages; payloads of any length are written and read
whole, in segments; other columns aren't read, so none can clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm.common import materialise, small

_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = 4096) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for at in range(0, len(payload), size) if (c := payload[at:at + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[line + 2 + size:line + 4 + size] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[line + 2:line + 2 + size])
        at = line + 4 + size


def payload_of(block: bytes, digest: str | None) -> bytes:
    """Payload of a whole HTTP response block, checked against the record's digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest and digest != sha1_label(payload):
        raise ValueError(f"payload digest differs from {digest}")
    return payload


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its closing line ends (the writer adds them)."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id, url, payload: bytes, refers_to, record_id: str, refers_id: str, segment_bytes: int):
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url is not None else None
    digest = sha1_label(payload)
    base = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest),
            ("Content-Type", "application/http;msgtype=response")]
    if refers_id:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Refers-To", f"<{refers_id}>"),
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *base], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    one = len(parts) == 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Segment-Number", None if one else 1), *base], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"),
                      ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None),
                      ("WARC-Date", "2024-01-01T00:00:00Z")], part)


def write_archive(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html",
                  segment_bytes: int = 16384, min_revisit: int = 1000, records_per_file: int = 4000) -> None:
    src = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"),
                       F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    src = src.select("*", F.unhex(F.sha2("payload", 256)).alias("content"))
    long = F.length("payload") >= min_revisit
    same = (src.where(long).groupBy("content").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").drop("n"))
    same = small(materialise(same, "warc-equal"))
    name = lambda p: F.concat(F.lit("urn:page:"), F.coalesce(p.cast("string"), F.lit("none")), F.lit(":"),
                              F.substring(F.lower(F.hex("content")), 1, 32))
    joined = src.join(same, "content", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"),
                         name(F.col("page_id")).alias("id"), F.when(revisit, name(F.col("first"))).alias("refers_id"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cols = [c.to_pylist() for c in b.slice(at, 512).columns]
                out = [r for row in zip(*cols) for r in page_records(*row, segment_bytes)]
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse_records(stream: io.BufferedIOBase):
    """(fields, block) of every record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != _END.encode():
            raise ValueError("record ends early")
        yield fields, block


def _scan(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """Records of all files: the whole ones decoded, or those that are segments."""
    names = ["id", "type", "refers", "digest", "segment", "total", "body"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def rows(content):
        with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
            for x, block in parse_records(f):
                number, digest = x.get("warc-segment-number"), x.get("warc-payload-digest")
                if (number is not None) != segments:
                    continue
                kind = x["warc-type"]
                body = block if segments else payload_of(block, digest) if kind == "response" else b""
                yield (x.get("warc-segment-origin-id", x["warc-record-id"])[1:-1], kind, x.get("warc-refers-to", "<>")[1:-1] or None,
                       digest, number and int(number), int(x["warc-segment-total-length"]) if "warc-segment-total-length" in x else None, body)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                held, size = [], 0
                for r in rows(b.column(0)[i].as_py()):
                    held.append(r)
                    size += len(r[-1])
                    if size > 4_000_000 or len(held) >= 2000:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "id string, type string, refers string, digest string, segment long, total long, body binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``id, type, refers, payload``, one row per page that was written."""
    whole = _scan(spark, path, False).select("id", "type", "refers", F.col("body").alias("payload"))
    parts = _scan(spark, path, True)
    # equal rows write equal segments: one of each, and how often
    once = parts.groupBy("id", "segment").agg(F.max("digest").alias("digest"), F.max("total").alias("total"),
                                              F.first("body").alias("body"), F.count(F.lit(1)).alias("times"))
    origin = once.groupBy("id").agg(F.max("digest").alias("digest"), F.max("total").alias("total"), F.max("times").alias("times"),
                                    F.sort_array(F.collect_list(F.struct("segment", "body"))).alias("parts"))

    def join_parts(batches):
        for b in batches:
            out = []
            for id_, digest, total, segments in zip(*[c.to_pylist() for c in b.columns[:3]], b.column(4).to_pylist()):
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise ValueError(f"{id_}: segments are missing")
                block = b"".join(s["body"] for s in segments)
                if len(block) != total:
                    raise ValueError(f"{id_}: {len(block)} bytes of {total}")
                out.append(payload_of(block, digest))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out, pa.binary())], names=["id", "times", "payload"])

    joined = origin.mapInArrow(join_parts, "id string, times long, payload binary")
    joined = joined.select("id", F.lit("response").alias("type"), F.lit(None).cast("string").alias("refers"), "payload",
                           F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")
    return whole.unionByName(joined)


def page_index(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per page; revisits get their original's figures."""
    page = lambda c: F.expr(f"try_cast(nullif(split({c}, ':')[2], 'none') AS BIGINT)")
    slim = materialise(records.select("id", "type", "refers", F.length("payload").cast("long").alias("payload_bytes"),
                                      F.sha1("payload").alias("payload_digest")), "warc-index")
    stored = slim.where("type = 'response'").select(F.col("id").alias("refers"), "payload_bytes", "payload_digest").distinct()
    # only originals that are referred to
    wanted = slim.where("type = 'revisit'").select("refers").distinct()
    stored = stored.join(wanted, "refers", "left_semi")
    again = slim.where("type = 'revisit'").drop("payload_bytes", "payload_digest").join(stored, "refers")
    return slim.where("type = 'response'").unionByName(again).select(
        page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers").alias("refers_to"))
