import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc

ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/\r\nX-Evil: 1", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://é/", "ß🙂\r\n\r\nWARC/1.1"), (6, "http://e/", "x" * 200_000), (None, "http://f/", "other"), (7, "http://g/", "other"), (8, "h", "dup"), (8, "h", "dup"), (10, "http://t/%0A\t\x1b\x7f%25?", "odd"), (11, "http://t/%0A", "even")]


def archive(spark, tmp_path, rows=ROWS, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    return warc.write_archive(df, f"file://{tmp_path}/archive", **options)


def test_round_trip(spark, tmp_path):
    got = warc.read_archive(spark, archive(spark, tmp_path)).collect()
    assert len(got) == len(ROWS) and len({re.search(rb"WARC-Record-ID: (.*)\r", bytes(r["record"]))[1] for r in got}) == len(ROWS)
    largest = {}
    for i, _, h in ROWS:
        largest[h or ""] = max(i or -1, largest.get(h or "", -1))
    texts = {i: h or "" for i, _, h in ROWS}
    for r in got:
        body = texts[r["id"]].encode()
        assert r["payload"] == body and r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = r["id"] == largest[body.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", largest[body.decode()]))
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and "X-Evil" not in fields
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
        assert rest == http + (body if first else b"") + b"\r\n\r\n" and int(fields["Content-Length"]) == len(rest) - 4
        assert r["url"] in [u or "" for i, u, _ in ROWS if i == r["id"]]
        assert ("WARC-Refers-To" in fields) == (not first)


def test_payload_is_stored_once(spark, tmp_path):
    path = archive(spark, tmp_path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    assert spark.read.parquet(f"{path}/headers").count() == len(ROWS)


def test_small_payloads_are_responses(spark, tmp_path):
    got = {r["id"]: r["record_type"] for r in warc.read_archive(spark, archive(spark, tmp_path, ROWS[:4], min_revisit_bytes=5)).collect()}
    assert set(got.values()) == {"response"}


def test_changed_payload_stops_the_read(spark, tmp_path):
    path = archive(spark, tmp_path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, f"{path}2").select("id", "payload_digest").collect()


def test_empty(spark, tmp_path):
    assert warc.read_archive(spark, archive(spark, tmp_path, ROWS[:0])).count() == 0
