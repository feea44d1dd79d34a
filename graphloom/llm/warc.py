"""WARC archives: records for web captures, and transaction assembly when reading them.

Writing: each capture gives a request, a response (or, for a payload seen before, a revisit) and a metadata record, tied by
WARC-Concurrent-To. Of equal payloads of ``REVISIT_BYTES`` or more, that of the smallest page id is kept as a response. Archives
are WARC/1.1 inside gzip, written by the text writer with the record end as line separator, so they may go to any
store Spark writes to.

Reading: gzip files, compressed whole or by record, stream through the text reader in pieces between blank lines, which a parser puts
together again by Content-Length, so payloads may hold anything and a task holds one record at a time. Request and metadata
records join their capture through concurrent-to identifiers, given on either side; the result is one nested row
per capture: its record with the payload, and arrays of request and metadata records. Records that belong to no capture form rows of their own.

Scale: payloads are shuffled once when writing, to meet the first of equal ones (a frequent payload is a skewed join that
the runtime splits; the groups are pre-aggregated), and once when assembling; records without the payloads of captures are parsed to a table
first, so that only one side of one join is wide. Files hold ``FILE_BYTES`` on average, before compression (their
number of records follows from the mean size); Spark's writers compress a file as one gzip member, not record by record.

Edge cases: null html: an empty payload; null url: empty target; null page id: always a response; repeated rows are captures
each, responses where they have the smallest id; control characters in a url are percent-encoded in the header; a very long payload is
one record; further columns, whatever their names, are not read; an empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import materialize, new_path, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REVISIT_BYTES = 100
#: Bytes of a file on average, before compression; bytes of marks that a record has besides its payload, about.
FILE_BYTES, RECORD_BYTES = 64_000_000, 400
END = "\r\n\r\n"
_END = END.encode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "record_id string, type string, url string, date string, concurrent_to array<string>, headers map<string, string>, http_headers map<string, string>, payload binary, payload_bytes long, payload_digest string, refers_to string"
_BATCH, _BATCH_BYTES = 500, 16_000_000


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """WARC records as text (value), three for each row of pages."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    large = own.where(F.col("size") >= REVISIT_BYTES)
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    seen = own.join(firsts, F.col("digest") == F.col("of"), "left").withColumn("uid", F.monotonically_increasing_id())

    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    urn = lambda kind: F.concat(F.lit(f"<urn:graphloom:{kind}:"), name, F.lit(":"), F.col("uid"), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "\x00", "%00")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    revisit = F.coalesce((F.col("id") != F.col("first")) & (F.col("size") >= REVISIT_BYTES), F.lit(False))

    def record(kind, urn_, extra, content_type, block):
        return F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", urn_), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", url), extra,
            line("Content-Type", F.lit(content_type)), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
        )

    capture = F.col("capture")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    told = F.concat(line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To-Page", F.col("first").cast("string")))).otherwise(F.lit("")))
    response = record(F.when(revisit, "revisit").otherwise("response"), capture, told, "application/http;msgtype=response", F.concat(http, F.when(revisit, "").otherwise(F.col("html"))))
    tied = line("WARC-Concurrent-To", capture)
    request = record(F.lit("request"), urn("request"), tied, "application/http;msgtype=request", F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + END)))
    metadata = record(F.lit("metadata"), urn("metadata"), tied, "application/warc-fields", line("page-id", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    return seen.withColumn("capture", urn("capture")).select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, **columns: str) -> str:
    """Write pages as gzipped WARC files under path, a new folder."""
    html = columns.get("html_col", "html")
    row = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length(html).cast("long")).alias("size")).first()
    mean = (row["size"] or 0) / max(1, 3 * row["n"]) + RECORD_BYTES
    records(pages, **columns).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(3, int(file_bytes / mean))).text(path)
    return path


def _fields(block: bytes) -> list[tuple[str, str]]:
    out = []
    for line in block.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon:
            out.append((key.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()))
    return out


class Parser:
    """Records out of a stream of bytes."""

    def __init__(self):
        self.buffer, self.need = bytearray(), 0

    def feed(self, data: bytes) -> Iterator[dict]:
        """The records that data completes."""
        self.buffer += data
        while len(self.buffer) >= self.need:
            at = self.buffer.find(b"WARC/")
            end = self.buffer.find(_END, at) if at >= 0 else -1
            if end < 0:
                return
            head = _fields(bytes(self.buffer[self.buffer.index(b"\r\n", at) + 2 : end]))
            start = end + len(_END)
            stop = start + int(dict(head)["content-length"])
            if len(self.buffer) < stop:
                self.need = stop
                return
            block = bytes(self.buffer[start:stop])
            del self.buffer[:stop]
            self.need = 0
            yield record_of(head, block)


def record_of(head: list[tuple[str, str]], block: bytes) -> dict:
    """A record (see RECORDS) of its header fields and its block."""
    headers, http, payload = dict(head), [], block
    if headers.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(_END)
        http = _fields(top.partition(b"\r\n")[2])
    kind, length, digest = headers.get("warc-type"), len(payload), None
    if kind == "revisit":  # what was kept elsewhere
        length = int(dict(http).get("content-length", length))
        digest = headers.get("warc-payload-digest", "").rpartition(":")[2]
    elif kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
    return {
        "record_id": headers.get("warc-record-id"), "type": kind, "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        "concurrent_to": [v for k, v in head if k == "warc-concurrent-to"], "headers": head_map(head), "http_headers": head_map(http), "payload": payload,
        "payload_bytes": length, "payload_digest": digest, "refers_to": headers.get("warc-refers-to-page"),
    }


def head_map(fields: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return list(dict(fields).items())


def _parse(kinds: list[str] | None, payloads_of: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces (file, piece) in the order of their files; a piece ended in END, but for one that is a whole file."""
        pairs, text = pa.map_(pa.string(), pa.string()), pa.string()
        schema = pa.schema([("record_id", text), ("type", text), ("url", text), ("date", text), ("concurrent_to", pa.list_(text)), ("headers", pairs), ("http_headers", pairs), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", text), ("refers_to", text)])
        file, parser, rows, size = None, Parser(), [], 0
        for batch in batches:
            for of, piece in zip(batch.column(0), batch.column(1), strict=True):
                if of.as_py() != file:
                    file, parser = of.as_py(), Parser()
                for r in parser.feed(piece.as_py() + _END):
                    if kinds is not None and r["type"] not in kinds:
                        continue
                    if payloads_of is not None and r["type"] not in payloads_of:
                        r["payload"] = None
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if len(rows) >= _BATCH or size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_records(spark: SparkSession, path: str, kinds: list[str] | None = None, payloads_of: list[str] | None = None, compressed: bool = True) -> DataFrame:
    """One row per WARC record (see RECORDS) of gzip files, or with compressed=False of plain ones (each read whole, as they could be split).

    kinds: the record types wanted; payloads_of: those whose payload is wanted (None: all). Lengths and digests are of the full payload either way.
    """
    if compressed:
        pieces = spark.read.option("lineSep", END).text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    else:
        pieces = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), F.col("content").alias("piece"))
    return pieces.mapInArrow(_parse(kinds, payloads_of), RECORDS)


def assemble(found: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """One row per capture: capture_id, capture (its record), requests and metadata (arrays of records, by id).

    wide: the records of captures to nest, where those of found lack their payloads.
    """
    is_capture = F.col("type").isin("response", "revisit")
    captures, others = found.where(is_capture), found.where(F.col("type").isin("request", "metadata"))
    forth = others.select(F.explode_outer("concurrent_to").alias("capture_id"), F.col("record_id").alias("other_id"))
    back = captures.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("other_id"))
    ties = forth.unionByName(back).distinct()
    whole = F.struct(*found.columns)
    tied = ties.join(others.select(F.col("record_id").alias("other_id"), whole.alias("record")), "other_id")
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("record.type") == kind, F.col("record"))), by_id)
    tied = tied.groupBy(F.coalesce("capture_id", "other_id").alias("capture_id")).agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    nested = (captures if wide is None else wide.where(is_capture)).select(F.col("record_id").alias("capture_id"), whole.alias("capture"))
    return nested.join(tied, "capture_id", "full_outer")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    narrow = materialize(read_records(spark, path, payloads_of=["request", "metadata"]), "records")
    rows = assemble(narrow, read_records(spark, path, kinds=["response", "revisit"]))
    page = F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), "page-id: (-?[0-9]*)", 1)
    kept = F.col("capture.type") == "response"
    return rows.select(
        F.nullif(page, F.lit("")).cast("long").alias("page_id"),
        F.when(kept, F.octet_length("capture.payload").cast("long")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(kept, F.sha2("capture.payload", 256)).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").cast("long").alias("refers_to"),
    )


ORACLE = """
WITH own AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM own)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM firsts
"""
