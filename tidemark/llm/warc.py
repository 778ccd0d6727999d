"""Writing captures as WARC records and assembling them again.

Each page becomes a transaction of three records: a request, a response (or a revisit of an earlier equal
payload) and a metadata record; the first and the last name the response in ``WARC-Concurrent-To``. Archives
are read back by their ``Content-Length`` fields, and the transactions are put together by joining records on
those identifiers, one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_path

MIN_REVISIT_BYTES = 100
#: (most bytes of a payload, captures of one file) by class of size: a file, which is read in one piece, holds about
#: 32 MB or one capture.
FILE_CLASSES = ((16 << 10, 2000), (512 << 10, 60), (8 << 20, 4), (None, 1))
#: Repeated payloads are joined by broadcast up to so many rows (32 + 8 bytes each), beyond that by a shuffle.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
RECORD = "type string, id string, concurrent_to string, uri string, header_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def _record(kind, rid, block, *headers):
    """One record without the two line ends that close it; null headers are left out."""
    head = F.concat_ws("\r\n", F.lit("WARC/1.0"), F.lit("WARC-Type: " + kind) if isinstance(kind, str) else F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), rid, F.lit(">")), F.lit("WARC-Date: " + DATE), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), block)


def size_class(n):
    """Number of the first of FILE_CLASSES that holds payloads of n bytes."""
    out = F.lit(len(FILE_CLASSES) - 1)
    for i in reversed(range(len(FILE_CLASSES) - 1)):
        out = F.when(n <= FILE_CLASSES[i][0], i).otherwise(out)
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES) -> None:
    """Write every row of ``pages`` as three records below ``path``; files end up in the store that Spark writes to.

    Null html is an empty payload, a null url leaves its header out (line ends in urls are percent-coded), a
    null id leaves its metadata field out. Among rows with equal payloads of ``min_revisit`` bytes or more, those
    with the smallest non-null id are responses; if all ids are null, all are. Repeated rows are captures of
    their own.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    equal = p.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    equal = materialize(equal, "equal-payloads")
    if equal.count() <= BROADCAST_ROWS:
        equal = F.broadcast(equal)
    p = p.join(equal, "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    p = p.withColumn("revisit", revisit)
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    uri = F.concat(F.lit("WARC-Target-URI: "), clean)
    rid = F.col("ids")[0]
    partner = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), rid, F.lit(">"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = lambda s: F.lit(f"Content-Type: application/http; msgtype={s}")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html")))
    profile = F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    answer = _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), rid, block, uri, digest, profile, http("response"))
    ask = _record("request", F.col("ids")[1], F.concat(F.lit("GET "), F.coalesce(clean, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), uri, partner, http("request"))
    field = lambda name, c: F.concat(F.lit(name + ": "), c.cast("string"))
    about = F.concat(F.concat_ws("\r\n", field("page-id", F.col("page_id")), field("payload-bytes", F.col("n")), F.when(F.col("revisit"), field("refers-to-page", F.col("first")))), F.lit("\r\n"))
    meta = _record("metadata", F.col("ids")[2], about, uri, partner, F.lit("Content-Type: application/warc-fields"))
    # at most one row a class; a pass over the pages for each that is there
    there = {r["class"] for r in pages.select(size_class(F.octet_length(F.coalesce(html_col, F.lit("")))).alias("class")).distinct().collect()}
    for i in sorted(there) or [0]:
        # uuid() is drawn once a row here, and all three records of the row are made from that draw
        drawn = p.where(size_class(F.col("n")) == i).withColumn("ids", F.array(F.expr("uuid()"), F.expr("uuid()"), F.expr("uuid()")))
        out = drawn.select(F.explode(F.array(ask, answer, meta)).alias("value"))
        out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 3 * FILE_CLASSES[i][1]).text(f"{path}/{i}")


def _lines(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def inflate(data: bytes) -> bytes:
    """Plain bytes of an archive, which may be gzip of one or many members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out) if out else data


def parse_archive(data: bytes, with_payload: bool = False):
    """Yield one dict a record, in order. A record that doesn't start with ``WARC/`` or ends early raises ValueError."""
    data = inflate(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        h = _lines(data[at:end])
        start = end + 4
        at = start + int(h["content-length"])
        if at > len(data):
            raise ValueError(f"record at byte {start} ends early")
        block, kind = data[start:at], h.get("warc-type")
        payload = None
        if kind == "response":
            cut = block.find(b"\r\n\r\n")
            payload = block[cut + 4 :] if cut >= 0 else b""
        strip = lambda x: x and x.strip("<>")
        yield {
            "type": kind,
            "id": strip(h.get("warc-record-id")),
            "concurrent_to": strip(h.get("warc-concurrent-to")),
            "uri": h.get("warc-target-uri"),
            "header_digest": h.get("warc-payload-digest"),
            "payload_bytes": None if payload is None else len(payload),
            "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest(),
            "fields": list(_lines(block).items()) if kind == "metadata" else None,
            "payload": payload if with_payload else None,
        }


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records below ``path`` (plain or gzip), one row each. A file is read in one piece."""
    schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("uri", pa.string()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for r in parse_archive(batch.column(0)[i].as_py(), with_payload):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,warc,gz}").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit): ``response``, ``request``, ``metadata``.

    A capture without a request or a metadata record has null there. Several records of a kind that name the
    same capture: the one with the smallest record id is taken, by a pre-aggregated minimum. Records that name
    no capture that is there are dropped.
    """

    def partner(kind, *columns):
        r = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return r.groupBy(F.col("concurrent_to").alias("to")).agg(F.min_by(F.struct("id", *columns), "id").alias(kind))

    answer = records.where(F.col("type").isin("response", "revisit")).select("id", F.struct("type", "id", "uri", "header_digest", "payload_bytes", "payload_digest", "payload").alias("response"))
    out = answer.join(partner("request", "uri"), F.col("id") == F.col("to"), "left").drop("to")
    return out.join(partner("metadata", "fields"), F.col("id") == F.col("to"), "left").select("response", "request", "metadata")


def capture_digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures. Responses count what
    was read; revisits, which hold no payload, give what their records say of it."""
    field = lambda name: F.element_at("metadata.fields", name).cast("long")
    return captures.select(
        field("page-id").alias("page_id"),
        F.coalesce(F.col("response.payload_bytes"), field("payload-bytes")).alias("payload_bytes"),
        F.coalesce(F.col("response.payload_digest"), F.expr("substring_index(response.header_digest, ':', -1)")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, assemble, and give one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    # a file goes to Python by itself
    records = materialize(read_archives(spark, path).drop("payload"), "warc-records", batch_rows=1).withColumn("payload", F.lit(None).cast("binary"))
    return capture_digest(assemble(records))


def oracle() -> str:
    return f"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
m as (select payload_digest, min(page_id) first from p where payload_bytes >= {MIN_REVISIT_BYTES} group by 1)
select p.page_id, payload_bytes, payload_digest, case when first <> p.page_id then 'revisit' else 'response' end record_type, case when first <> p.page_id then first end refers_to
from p left join m using (payload_digest)"""
