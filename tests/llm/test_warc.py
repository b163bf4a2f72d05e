import hashlib
import html
import re
from html import entities

import duckdb
from pyspark.sql import functions as F

from foliospark.llm.warc import SQL, decode_references, derive, responses, serialise

SCHEMA = "page_id long, url string, html string"


def test_records(spark):
    page = '<html lang="de"><head><title> A &amp; B\n</title><style>p{}</style></head><body><p>One <b>two</b><!-- x --><br>3 &lt; 4<script>var t="</p>";</script><a href="/x">L</a></body>'
    pages = spark.createDataFrame([(1, "http://e.org/", page, 5), (2, None, None, 5), (None, "u", "", 5), (1, "http://e.org/", page, 5)], SCHEMA + ", block int")
    rows = serialise(derive(responses(pages))).collect()
    assert len(rows) == 8
    by = {(r.page_id, r.warc_type): r for r in rows}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    assert text.block == "A & B\nOne two\n3 < 4L"
    assert meta.refers_to == text.refers_to and meta.record_id == text.concurrent_to and text.record_id == meta.concurrent_to
    assert "title: A & B\r\nlanguage: de\r\noutlinks: 1\r\n" in meta.block and text.block_digest[7:] in meta.block
    assert text.source_payload_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
    assert text.source_headers.endswith(f"Content-Length: {len(page.encode())}")
    for r in rows:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert body == r.block.encode() + b"\r\n\r\n" and f"Content-Length: {len(r.block.encode())}".encode() in head
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
    assert by[2, "conversion"].block == "" and by[None, "conversion"].target_uri == "u"
    assert derive(responses(pages.limit(0))).count() == 0


def test_long_page(spark):
    page = "<p>" + "a < b <i>c</i> " * 100_000 + "</p>"
    assert derive(responses(spark.createDataFrame([(1, "u", page)], SCHEMA))).where("warc_type = 'conversion'").first().block.count("c") == 100_000


def test_long_hidden_parts(spark):
    page = "<p>a</p><!--" + "- x " * 100_000 + "--><script>" + "if (a < b) {} " * 50_000 + "</script><p>b</p>"
    assert derive(responses(spark.createDataFrame([(1, "u", page)], SCHEMA))).where("warc_type = 'conversion'").first().block == "a\nb"


def test_character_references(spark):
    texts = [f"x{n};y &amp;{n}; &{n.upper()};" for n in ("&eacute", "&#233", "&mdash", "&#8217", "&#x27", "&#X1F600", "&#0", "&#x80", "&#xD800", "&#x110000", "&#150", "&CounterClockwiseContourIntegral", "&NotEqualTilde")]
    texts += ["caf&eacute; &#233; &mdash; &amp;lt;", "a & b; c", "&#38;amp; &AMP;lt; &#x26;#60; &amp;amp;", "&;", "&#;", "&#x;", "&unknown;", "& & &", "&amp", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    strict = lambda t: re.sub(r"&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in entities.html5 else m[0], t)
    assert {r.text: r.got for r in decode_references(frame.withColumn("got", F.col("text")), "got").collect()} == {t: strict(t) for t in texts}
    every = spark.createDataFrame([(f"&{n}",) for n in entities.html5 if n.endswith(";")], "text string")
    assert all(r.got == html.unescape(r.text) for r in decode_references(every.withColumn("got", F.col("text")), "got").collect())


def test_no_header_from_a_url(spark):
    pages = spark.createDataFrame([(1, "u\r\nX-Evil: 1\t\x7f", "<p>caf&eacute;</p>")], SCHEMA)
    for r in serialise(derive(responses(pages))).collect():
        head = bytes(r.record).split(b"\r\n\r\n", 1)[0].decode().split("\r\n")
        assert "WARC-Target-URI: u%0D%0AX-Evil: 1%09%7F" in head and not any(line.startswith("X-Evil") for line in head)
        assert "WARC-Source-Header: HTTP/1.1 200 OK" in head and "WARC-Source-Header: Content-Type: text/html; charset=utf-8" in head
        assert r.warc_type == "metadata" or r.block == "café"


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    assert {tuple(r) for r in derive(responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()} == set(con.sql(SQL).fetchall())
