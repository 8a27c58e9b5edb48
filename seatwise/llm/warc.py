"""WARC archives with revisit records for repeated payloads.

Writing: the payload digests are shuffled, the largest page_id of each becomes the original, and the pages are joined with the originals.
An original is a response with its whole payload, the others are revisit records with fresh headers that refer to it. A record is one
text, and records end in two line breaks, so Spark's text writer makes the gzipped archives, with its commit protocol: a lost
executor's half-written file is never part of the result.

Reading: archives are parsed record by record by their Content-Length, payloads are measured and hashed again, and revisit records are
resolved by a join with the responses on the payload digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK = "\r\n"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: Column) -> Column:
    """A URI for a page's record, from its id."""
    name = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    parts = [F.substring(name, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_originals(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and, for revisits, the original's page_id."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    originals = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
                 .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    met = rows.join(originals, "payload_digest", "left")
    return met.withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))


def record(date: str) -> Column:
    """The text of a page's record, without the two line breaks that end it."""
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    headers = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(record_id(F.col("page_id")), record_id(F.lit("none")))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("original")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(BREAK, *headers), F.lit(BREAK * 2), block)  # concat_ws leaves out headers that are null


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000,
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes gzipped archives with one record per page to the new folder ``path``.

    Pages whose payloads are equal and have at least ``least`` bytes share one response, that of the largest page_id. A null html is
    an empty payload, a null url has no target header. Repeated rows of the original are responses each. A null page_id revisits the
    original of its payload, and is a response where no row of its group has an id. An empty table gives archives without records.
    """
    records = with_originals(pages, page_id, url, html, least).select(record(date).alias("value"))
    records.write.text(path, compression="gzip", lineSep=BREAK * 2)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and block of each record of a gzipped archive."""
    with gzip.open(io.BytesIO(archive)) as lines:
        while line := lines.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not the start of a WARC record: {line[:80]!r}")
            headers = {}
            while (line := lines.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            block = lines.read(int(headers["content-length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield headers, block


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload_digest and, for responses, payload_bytes of every record; damaged payloads are an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                rows = []
                for headers, block in parse(archive.as_py()):
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2]
                    payload = block.partition(b"\r\n\r\n")[2]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
                    number = headers.get("x-page-id")
                    rows.append((number and int(number), kind, digest, len(payload) if kind == "response" else None))
                page, kinds, digests, sizes = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(kinds, pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())],
                    ["page_id", "record_type", "payload_digest", "payload_bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, "page_id long, record_type string, payload_digest string, payload_bytes long")


def resolve(headers: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to: revisit records get size and page of their response."""
    revisits = headers.where("record_type = 'revisit'").select("page_id", "payload_digest")
    wanted = headers.where("record_type = 'response'").groupBy("payload_digest").agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    found = revisits.join(wanted, "payload_digest").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    responses = headers.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(found)
