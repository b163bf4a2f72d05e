"""Operator 9: WARC derivatives of response records.

Each response gives a ``metadata`` record (application/warc-fields) and a
``conversion`` record (text/plain).  Both refer to the response by
WARC-Refers-To and to each other by WARC-Concurrent-To, and keep its target,
date, HTTP headers and digests.  All of it is column expressions: no shuffle,
no Python.

Record ids are UUIDs made from the MD5 of a name, so a rerun gives the same
ids.  Digests are SHA-256 in lower-case hexadecimal digits.

Plain text: comments and the contents of script, style, noscript and template
go; block elements end lines; other tags go; character references that end in a
semicolon are decoded, all names of HTML and all numbers, once; blanks are
collapsed and empty lines go.

Defined results: a null html is an empty payload, which gives records with an
empty text; a null url gives an empty target; control characters in a url are
percent-encoded, so that no url adds a header line; a name that HTML doesn't have stays as it is; a null page_id is the id 'null';
repeated rows give records with equal ids; other columns are not looked at; an
empty table gives no records.
"""

from __future__ import annotations

import html as html_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
#: References that are replaced by themselves, before any other one, and the ampersand after all.
FREQUENT = ("nbsp", "quot", "lt", "gt", "apos", "#39", "copy", "middot")
#: Name and character.  An ampersand stays a reference here, so that what it makes isn't decoded again.
NAMES = {n[:-1]: c.replace("&", "&amp;") for n, c in sorted(html_.entities.html5.items()) if n.endswith(";")}
#: Numbers that stand for another character than their own.
NUMBERS = {n: html_.unescape(f"&#{n};") for n in (0, 13, *range(128, 160))} | {38: "&amp;"}
CONTROLS = [*range(32), 127]


def patterns() -> list[tuple[str, str]]:
    """(pattern, replacement), in order, in the dialect that Java and RE2 share."""
    return [
        (r"(?s)<!--.*?-->", ""),
        *((rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>", "") for name in HIDDEN),
        (rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>", "\n"),
        (r"</?[A-Za-z!?][^>]*>", ""),
    ]


def decode_references(df: DataFrame, *names: str) -> DataFrame:
    """df with the character references in the named columns replaced, once.

    In two steps, of which the second uses the first's result several times, so
    that Catalyst works it out once.
    """
    first, second = {}, {}
    for name in names:
        made = F.col(name)
        for reference in FREQUENT:
            made = F.replace(made, F.lit(f"&{reference};"), F.lit(html_.unescape(f"&{reference};")))
        first[name] = made
        text = F.col(name)
        rare = F.when(text.rlike("&(?!amp;)(?:#|[A-Za-z][A-Za-z0-9]*;)"), _decoded(text)).otherwise(text)
        second[name] = F.when(F.contains(text, F.lit("&")), F.replace(rare, F.lit("&amp;"), F.lit("&"))).otherwise(text)
    return df.withColumns(first).withColumns(second)


def _decoded(text: Column) -> Column:
    """text with all references but that of an ampersand replaced: each piece after an ampersand begins with a reference or is left."""
    names = F.map_from_arrays(*[F.split(F.lit("\x01".join(x)), "\x01", -1) for x in (NAMES, NAMES.values())])
    numbers = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])

    def piece(x: Column) -> Column:
        body = F.regexp_extract(x, "^(#[xX][0-9a-fA-F]{1,7}|#[0-9]{1,9}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(F.substring(body, 2, 1).isin("x", "X"), F.conv(F.substring(body, 3, 9), 16, 10).cast("int")).otherwise(F.substring(body, 2, 9).cast("int"))
        own = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        character = F.when(F.substring(body, 1, 1) == "#", F.coalesce(F.try_element_at(numbers, code), own)).otherwise(F.try_element_at(names, body))
        return F.coalesce(F.when(body != "", F.concat(character, F.substring(x, F.length(body) + 2, F.length(x)))), F.concat(F.lit("&"), x))

    pieces = F.split(text, "&", -1)
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))


def encoded_uri(url: Column) -> Column:
    """url with its control characters percent-encoded."""
    made = url
    for c in CONTROLS:
        made = F.replace(made, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), made).otherwise(url)


def without_markup(html: Column) -> Column:
    for pattern, replacement in patterns():
        html = F.regexp_replace(html, pattern, replacement)
    return html


def tidy(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t\r\f\x{A0}]+", " ")
    return F.trim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def uuid(*parts: Column) -> Column:
    digits = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of fetched pages (page_id, url, html)."""
    page, url, html = F.col("page_id").cast("string"), F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(page, F.lit("null")).alias("page"), F.col("page_id").cast("long"), encoded_uri(url).alias("target_uri"), html.alias("payload"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"))
    return rows.select(
        "page_id", uuid(F.lit("response"), "page", "target_uri").alias("record_id"), "target_uri", F.lit(date).alias("date"), headers.alias("http_headers"),
        "payload", sha256(F.col("payload")).alias("payload_digest"), sha256(F.concat(headers, F.lit("\r\n\r\n"), F.col("payload"))).alias("block_digest"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response of ``records`` (the columns of responses()); the body is in ``block``."""
    title = F.regexp_extract("payload", r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    language = F.regexp_extract("payload", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)
    links = F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href="))
    named = records.select(
        "*", without_markup(F.col("payload")).alias("text"), title.alias("title"), language.alias("language"), links.alias("links"),
        uuid(F.lit("metadata"), "record_id").alias("metadata_id"), uuid(F.lit("conversion"), "record_id").alias("conversion_id"),
    )
    named = decode_references(named, "text", "title").withColumns({"text": tidy(F.col("text")), "title": F.trim(F.regexp_replace("title", r"\s+", " "))})
    fields = F.concat(
        F.lit("title: "), "title", F.lit("\r\nlanguage: "), "language", F.lit("\r\noutlinks: "), F.col("links").cast("string"),
        F.lit("\r\nsource-block-digest: "), "block_digest", F.lit("\r\nconversion-block-digest: "), sha256(F.col("text")), F.lit("\r\n"),
    )
    metadata = F.struct(F.lit("metadata").alias("type"), F.col("metadata_id").alias("id"), F.col("conversion_id").alias("with"), F.lit("application/warc-fields").alias("kind"), fields.alias("block"))
    conversion = F.struct(F.lit("conversion").alias("type"), F.col("conversion_id").alias("id"), F.col("metadata_id").alias("with"), F.lit("text/plain; charset=utf-8").alias("kind"), F.col("text").alias("block"))
    made = named.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", F.explode(F.array(metadata, conversion)).alias("made"))
    return made.select(
        "page_id", F.col("made.type").alias("warc_type"), F.col("made.id").alias("record_id"), F.col("record_id").alias("refers_to"), F.col("made.with").alias("concurrent_to"),
        "target_uri", F.col("date").alias("warc_date"), F.col("made.kind").alias("content_type"), F.octet_length("made.block").cast("long").alias("content_length"),
        sha256(F.col("made.block")).alias("block_digest"), F.col("payload_digest").alias("source_payload_digest"), F.col("http_headers").alias("source_headers"), F.col("made.block").alias("block"),
    )


def serialise(derived: DataFrame) -> DataFrame:
    """derived with ``record``, the bytes of the WARC/1.1 record; each HTTP header line of the response is a WARC-Source-Header."""
    source = F.array_join(F.transform(F.split("source_headers", "\r?\n"), lambda line: F.concat(F.lit("WARC-Source-Header: "), line, F.lit("\r\n"))), "")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "warc_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Refers-To: "), "refers_to",
        F.lit("\r\nWARC-Concurrent-To: "), "concurrent_to", F.lit("\r\nWARC-Target-URI: "), "target_uri", F.lit("\r\nWARC-Date: "), "warc_date",
        F.lit("\r\nWARC-Block-Digest: "), "block_digest", F.lit("\r\nWARC-Source-Payload-Digest: "), "source_payload_digest",
        F.lit("\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n"), source, F.lit("\r\n"),
    )
    return derived.withColumn("record", F.encode(F.concat(header, "block", F.lit("\r\n\r\n")), "UTF-8"))


#: The references that the table pages has; all others are tested against Python's decoder.
SQL_NAMES = ("&nbsp;", "&lt;", "&gt;", "&quot;", "&#39;", "&apos;", "&copy;", "&middot;", "&amp;")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_names(text: str) -> str:
    for name in SQL_NAMES:
        text = f"replace({text}, {quote(name)}, {quote(html_.unescape(name))})"
    return text


def _sql_text() -> str:
    text = "payload"
    for pattern, replacement in patterns():
        text = f"regexp_replace({text}, {quote(pattern)}, {'chr(10)' if replacement else quote('')}, 'g')"
    text = _sql_names(text)
    text = f"regexp_replace({text}, '[ \\t\\r\\f\\x{{A0}}]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_uuid(name: str, *parts: str) -> str:
    m = f"md5(concat_ws('|', '{name}', {', '.join(parts)}))"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({m}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sql_uri(url: str) -> str:
    for c in CONTROLS[1:]:
        url = f"replace({url}, chr({c}), '%{c:02X}')"
    return url


_NL = "chr(13) || chr(10)"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), 'null') AS page, {_sql_uri("coalesce(url, '')")} AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT page_id, {_sql_uuid("response", "page", "target_uri")} AS rid, target_uri, payload,
  'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL} || 'Content-Length: ' || octet_length(encode(payload)) AS headers FROM p),
n AS (SELECT *, 'sha256:' || sha256(headers || {_NL} || {_NL} || payload) AS bd, {_sql_text()} AS text,
  trim(regexp_replace({_sql_names("regexp_extract(payload, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1)")}, '\\s+', ' ', 'g')) AS title,
  regexp_extract(payload, '(?i)<html[^>]*\\slang=["'']?([A-Za-z-]+)', 1) AS language,
  len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href=')) AS links,
  {_sql_uuid("metadata", "rid")} AS mid, {_sql_uuid("conversion", "rid")} AS cid FROM r),
d AS (
  SELECT *, 'metadata' AS t, mid AS id, cid AS other, 'application/warc-fields' AS kind,
    'title: ' || title || {_NL} || 'language: ' || language || {_NL} || 'outlinks: ' || links || {_NL} || 'source-block-digest: ' || bd || {_NL} || 'conversion-block-digest: sha256:' || sha256(text) || {_NL} AS block FROM n
  UNION ALL SELECT *, 'conversion', cid, mid, 'text/plain; charset=utf-8', text FROM n)
SELECT page_id, t AS warc_type, id AS record_id, rid AS refers_to, other AS concurrent_to, target_uri, '{DATE}' AS warc_date, kind AS content_type,
  CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(payload) AS source_payload_digest, headers AS source_headers, block FROM d
"""
