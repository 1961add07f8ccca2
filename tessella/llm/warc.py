"""Content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds each payload's bytes once, under the SHA-256 of those
bytes; ``headers`` holds the exact header block of each record with the digest of its payload. Records are put
together again by a join on the digest, after each stored payload has been checked against its digest; a payload
that doesn't match stops the read.

Of the records whose payloads are equal and of at least ``min_revisit_bytes`` bytes, the one with the largest id
is the response and the others are revisits that refer to it; smaller payloads are always responses.

A record's block is an HTTP message: its head is kept with the record's header, its body is the payload; a revisit has the
head only. What is read is parsed from the rebuilt records.

Edge cases: a null payload counts as empty; a null URL gives an empty WARC-Target-URI; a URL with control characters
is percent-encoded (these and ``%``), which a header field says, and decoded on reading; rows repeated with one id give
a record each, told apart by a number in their record ids, and are all responses if that id is the
largest; a null id is smaller than any other and is written as ``null``. Columns other than the three named ones
are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, table

URN = "urn:tessella:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: 160 bits are four times ten hexadecimal or eight base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


CONTROLS = [("%", "%25"), *((chr(k), f"%{k:02X}") for k in (*range(32), 127))]
ENCODED = "Tessella-Target-URI-Encoding: percent"


def encoded(url: Column) -> Column:
    """url with control characters and % percent-encoded."""
    for raw, safe in CONTROLS:
        url = F.replace(url, F.lit(raw), F.lit(safe))
    return url


def decoded(url: Column) -> Column:
    for raw, safe in reversed(CONTROLS):
        url = F.replace(url, F.lit(safe), F.lit(raw))
    return url


def _records(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(F.col(record_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))


def write_archive(pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes a record for each row of pages under path and returns path."""
    records = _records(pages, record_id, url, payload).withColumn("digest", F.sha2("payload", 256))
    records.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    rows = records.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("sha1"))
    largest = rows.groupBy("digest").agg(F.max("id").alias("response"))
    rows = rows.join(largest, "digest")
    revisit = (F.col("bytes") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("response"))
    same = Window.partitionBy("id", "digest").orderBy("url")
    rows = rows.withColumns({"copy": F.row_number().over(same), "odd": F.coalesce(F.col("url").rlike("[\\x00-\\x1F\\x7F]"), F.lit(False))})
    safe_url = F.when(F.col("odd"), encoded(F.col("url"))).otherwise(F.coalesce("url", F.lit("")))
    urn = lambda c, copy: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.col("sha1"), F.lit(":"), copy.cast("string"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"), F.col("copy"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.when(F.col("odd"), F.lit(ENCODED)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("response"), F.lit(1)))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.length(head) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), head).cast("binary")
    rows.select("digest", header.alias("header")).write.parquet(f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: its id, type, refers_to, url, payload (also of a revisit), payload_bytes, payload_digest and record, the exact bytes."""
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")))
    stored = spark.read.parquet(f"{path}/payloads").select("digest", checked.alias("stored"))
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    number = lambda name: F.expr(f"try_cast({name} as bigint)")
    own = rf"<{URN}([^:>]*):[^>]*>"
    headers = spark.read.parquet(f"{path}/headers").select(
        "digest", "header", field("WARC-Type", "([a-z]+)").alias("record_type"), field("WARC-Record-ID", own).alias("own"), field("WARC-Refers-To", own).alias("other"),
        F.when(F.contains(text, F.lit(f"\r\n{ENCODED}\r\n")), decoded(field("WARC-Target-URI", "([^\r]*)"))).otherwise(field("WARC-Target-URI", "([^\r]*)")).alias("url"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("stated"), F.expr(rf"try_cast(regexp_extract(decode(header, 'UTF-8'), '\\r\\nContent-Length: ([0-9]+)\\r\\n\\r\\n', 1) as bigint)").alias("length"),
    )
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("stored"))
    records = headers.join(stored, "digest").withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))
    # the block begins after the header's blank line and is as long as the header says; the payload begins after the block's blank line
    payload = F.when(F.col("record_type") == "revisit", F.col("stored")).otherwise(F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)"))
    fits = F.octet_length("record") - 4 - F.expr("octet_length(substring_index(decode(header, 'UTF-8'), '\\r\\n\\r\\n', 1))") - 4 == F.col("length")
    records = records.withColumn("payload", F.when(fits, payload).otherwise(F.raise_error(F.lit("a record isn't as long as it states"))))
    records = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": sha1_base32(F.col("payload"))})
    stated = F.when(F.col("stated") == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("a record states another digest than its payload's")))
    return records.select(number("own").alias("id"), "record_type", number("other").alias("refers_to"), "url", "payload", "payload_bytes", stated.alias("payload_digest"), "record")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archive(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex,
             max(page_id) OVER (PARTITION BY body) AS largest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(5 * (7 - i % 8) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM q
"""
