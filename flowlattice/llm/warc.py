"""WARC archives: writing with revisits for equal payloads, and a reader that salvages damaged ones.

Of records with equal payloads of at least `REVISIT_BYTES` bytes the one with the largest page id is written whole, the
others as revisits that refer to it; a revisit keeps the HTTP header with the full length. Archives are
plain WARC 1.1 files in the shared folder, written and read by Spark; a task starts a new one after as many records as make
`ARCHIVE_BYTES` on average.

The reader checks every record: version line, header, length, closing blank lines and both digests. Where a check
fails it looks for the next valid record, at a version line or the start of a gzip member, goes on from there, and
logs the bytes in between as a gap.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from flowlattice.llm import common
from flowlattice.session import shared_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8_000_000
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HEAD_END = re.compile(rb"\r\n\r\n|\r\nWARC/1\.[01]\r\n")  # a version line before the blank line is another record's
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_DIGEST = re.compile(r"sha1:[A-Z2-7]{32}")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest):
    return base64.b32encode(digest).decode()


def record(page_id, url, payload_bytes, payload_sha1, payload=None, refers_to=None):
    """One record as bytes; without `payload` a revisit of the page `refers_to`."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n").encode() + (payload or b"")
    revisit = payload is None
    # A line end or another control character cannot stand in a header line.
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Payload-Digest", f"sha1:{_base32(payload_sha1)}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}")]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class Damaged(ValueError):
    """A record that fails a check."""


def parse(data, at):
    """(fields, block, end) of the plain record at byte `at`; raises `Damaged`."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    closed = _HEAD_END.search(data, version.end() - 2)
    if not closed or len(closed[0]) > 4:
        raise Damaged("header not closed")
    end_of_head = closed.start()
    fields = {}
    for line in data[version.end():end_of_head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damaged("header line without a colon")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    start = end_of_head + 4
    end = start + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record not closed where its length says")
    block = data[start:end]
    digest = fields.get("warc-block-digest", "")
    if digest and digest != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        raise Damaged("block digest differs")
    payload = fields.get("warc-payload-digest", "")
    if payload and not _DIGEST.fullmatch(payload):
        raise Damaged("payload digest is none")
    if payload and fields.get("warc-type") == "response" and payload != f"sha1:{_base32(hashlib.sha1(block.partition(b'\r\n\r\n')[2]).digest())}":
        raise Damaged("payload digest differs")
    return fields, block, end + 4


def member(data, at):
    """(plain bytes, end) of the gzip member at byte `at`; raises `Damaged`."""
    unpack = zlib.decompressobj(31)
    try:
        plain = unpack.decompress(data[at:])
    except zlib.error as wrong:
        raise Damaged(f"gzip: {wrong}") from wrong
    if not unpack.eof:
        raise Damaged("gzip member cut off")
    return plain, len(data) - len(unpack.unused_data)


def salvage(data):
    """Yield ("record", start, end, fields, block) and ("gap", start, end, reason, None) over one archive's bytes."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            if data[at:at + 3] == b"\x1f\x8b\x08":
                plain, end = member(data, at)
                found, inner = [], 0
                while inner < len(plain):
                    fields, block, inner = parse(plain, inner)
                    found.append((fields, block))
            else:
                fields, block, end = parse(data, at)
                found = [(fields, block)]
        except Damaged as wrong:
            if gap is None:
                gap, reason = at, str(wrong)
            later = _START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        for fields, block in found:
            yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, None


def _page_of(value):
    found = re.fullmatch(r"<urn:page:(.*)>", value or "", re.S)
    return found[1] if found and found[1] else None


def contents(fields, block):
    """What a record says about its page, as a dict; the payload's length comes from the HTTP header."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type", "")
    return {"page_id": _page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": int(length[1]) if length else len(payload),
            "payload_digest": base64.b32decode(digest).hex() if digest else hashlib.sha1(payload).hexdigest(),
            "refers_to": _page_of(fields.get("warc-refers-to")), "payload": payload if kind != "revisit" else None}


def planned(pages):
    """(page_id, url, payload, payload_bytes, sha1, refers_to): which pages are revisits, without moving pages to each other.

    Equal payloads meet as digests only, with one partial maximum per digest, so a page copied a million times is no hot group.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.length("payload").cast("bigint")).withColumn(
        "sha1", F.sha1("payload"))
    large = rows.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    kept = large.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written first, so Spark knows its size: a small table is sent to the pages, and only a large one makes them move.
    revisits = common.materialized(large.select("page_id", "sha1", "payload_bytes").join(kept, ["sha1", "payload_bytes"]).where(
        "page_id < kept").select("page_id", "sha1", F.col("kept").alias("refers_to")).distinct(), "revisits")
    return rows.join(revisits, ["page_id", "sha1"], "left")


def write_archives(pages, folder):
    """Write `pages` (page_id, url, html) as WARC files into `folder`."""
    size, n = pages.agg(F.sum(F.length(F.coalesce("html", F.lit("")))), F.count("*")).first()
    per_file = max(1, int(ARCHIVE_BYTES * n / max(size or 0, 1)))

    def records(columns):
        rows = zip(*(columns[c] for c in ("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to")))
        made = [record(page, url, n, bytes.fromhex(sha1), None if to is not None else bytes(payload), to) for page, url, payload, n, sha1, to in rows]
        # The writer closes every record with the last line end.
        return {"record": [m[:-2] for m in made]}

    rows = common.map_rows(planned(pages), records, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option(
        "maxRecordsPerFile", min(per_file, 1_000_000)).text(folder)
    return folder


READ = ("archive string, start bigint, end bigint, gap string, page_id string, url string, record_type string, payload_bytes bigint, "
        "payload_digest string, refers_to string, payload binary")


def read_archives(spark, folder, payloads=True):
    """One row per record, and one per gap (`gap` says why, the other columns of a record are null) of all archives in `folder`."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    struct, arrow = common.arrow_schema(READ)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for kind, start, end, what, block in salvage(data):
                    found = {} if kind == "gap" else contents(what, block)
                    rows.append(found | {"archive": path, "start": start, "end": end, "gap": what if kind == "gap" else None})
                    if not payloads:
                        rows[-1].pop("payload", None)
                for low in range(0, max(1, len(rows)), 500):
                    some = rows[low:low + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in some], f.type) for f in arrow], schema=arrow)

    return files.mapInArrow(run, struct)


def round_trip(pages):
    """Write `pages` (page_id, url, html) and read the archives back.

    Null html is an empty payload. Null and repeated page ids are written like others, but a null id is never part of a
    revisit, and copies of the page to keep under its own id are all written whole. An empty table gives no record. A gap in the
    archives just written is an error.
    """
    spark = pages.sparkSession
    folder = write_archives(pages, f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")
    kind = pages.schema["page_id"].dataType.simpleString()
    whole = F.assert_true(F.col("gap").isNull(), F.concat(F.lit("gap in "), F.col("archive"), F.lit(": "), F.col("gap"))).isNull()
    return read_archives(spark, folder, payloads=False).where(whole).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op10_warc(spark, sf_dir):
    return round_trip(common.table(spark, sf_dir, "pages"))


# DuckDB: what the archives must say.
ORACLE_OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.page_id < k.kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < k.kept THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
"""
