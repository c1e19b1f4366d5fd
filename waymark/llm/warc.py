"""Operator 6, a content-addressed WARC archive.

Three steps, all relational:

* `records`: each page becomes a record. Payloads are named by the SHA-256 of their bytes; of equal
  payloads of at least `MIN_SHARED` bytes the smallest page id is the response and the others
  revisit it. Smaller payloads are all responses.
* `write`: two tables. `payloads` holds the bytes once per digest; `headers` holds each record's exact
  WARC and HTTP header bytes. Of the payloads with one digest the smallest and the largest are compared, byte for byte, before one of them is
  stored, so that a clash of digests fails the write.
* `whole`: joins headers with payloads by digest, which gives the original records byte for byte, and for revisits
  the payload they refer to. `read` parses the records that come out of it; it fails where a payload does not have its digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import materialize, shared_dir

MIN_SHARED = 100
DATE = "2024-01-01T00:00:00Z"


def _payload(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_shared: int = MIN_SHARED) -> DataFrame:
    """(row, page_id, url, digest, payload_bytes, response): one row per page, `row` being a number of its own; the payload's bytes stay where they are.

    `response` is (page_id, row) of the record that holds a shared payload, null for small payloads."""
    body = _payload(payload_col)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    rows = materialize(rows, "records")  # row numbers are given once
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    least = rows.filter(F.col("payload_bytes") >= min_shared).groupBy(F.col("digest").alias("_digest")).agg(first.alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    joined = rows.join(least, F.col("digest") == F.col("_digest"), "left")
    return joined.select("row", "page_id", "url", "digest", "payload_bytes", F.when(F.col("_first").isNotNull(), F.struct("_first.page_id", "_first.row")).alias("response"))


def _record_id(page_id: Column, row: Column) -> Column:
    """Unique in the archive: page ids may repeat or be missing."""
    return F.concat(F.lit("<urn:waymark:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))


def _header(uri: Column) -> Column:
    revisit = F.col("revisits").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("row"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("revisits.page_id"), F.col("revisits.row")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http).cast("binary")


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_shared: int = MIN_SHARED) -> str:
    """Write the archive below `path` (default: a new folder in the shared directory) and return it.

    Null payloads are empty; null URLs are empty; line breaks in URLs are percent-encoded. Record ids hold the page id and a row number, so rows that repeat an id
    or have none are records of their own: of the rows with the smallest id of a payload all are responses. Other columns are ignored.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/waymark/{uuid.uuid4().hex}/archive"
    rows = records(pages, id_col, url_col, payload_col, min_shared)
    first = F.col("response").isNull() | F.col("page_id").eqNullSafe(F.col("response.page_id"))
    rows = rows.withColumn("revisits", F.when(~first, F.col("response")))
    rows.select("page_id", "digest", "payload_bytes", _header(F.col("url")).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # the bytes: one row per digest; copies merge before the shuffle, as a partial aggregate
    body = _payload(payload_col)
    stored = pages.select(F.sha2(body, 256).alias("digest"), body.alias("payload")).groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("_other"))
    same = F.when(F.col("payload") == F.col("_other"), F.col("payload")).otherwise(F.raise_error(F.lit("payloads with one digest differ")).cast("binary"))
    stored.select("digest", same.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def whole(spark, path: str) -> DataFrame:
    """(page_id, header, payload, record): the original records byte for byte; written one after another they are a WARC file.

    A revisit's record ends with its headers; its payload is that of the record it refers to. Payloads are unique by digest, so a digest that very
    many records share makes a hot key on the side of the headers only, which Spark can split.
    """
    headers, payloads = (spark.read.parquet(f"{path}/{t}") for t in ("headers", "payloads"))
    joined = headers.select("page_id", F.col("digest").alias("_d"), "header").join(payloads, F.col("_d") == F.col("digest"))
    revisit = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nWARC-Type: ([a-z]+)\r\n", 1) == "revisit"
    end = F.lit("\r\n\r\n").cast("binary")
    return joined.select("page_id", "header", "payload", F.when(revisit, F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"))


def read(spark, path: str) -> DataFrame:
    """One row per reconstructed record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    All comes from the archive. A payload is hashed again; it must have the digest, and its record the length, that the headers name.
    """
    records = whole(spark, path).select("record", "payload", F.decode("header", "UTF-8").alias("_h"), F.octet_length("header").alias("_n"))

    def field(name: str, pattern: str) -> Column:
        return F.regexp_extract("_h", rf"\r\n{name}: {pattern}\r\n", 1)

    parsed = records.select(
        F.nullif(field("WARC-Record-ID", r"<urn:waymark:page:(?:none|(-?[0-9]+)):[0-9]+>"), F.lit("")).cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("_digest"),
        F.sha2("payload", 256).alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", r"<urn:waymark:page:(-?[0-9]+):[0-9]+>"), F.lit("")).cast("long").alias("refers_to"),
        F.octet_length("record").alias("_size"),
        # the block begins after the first empty line and ends before the two line breaks that close the record
        (F.length(F.regexp_extract("_h", r"(?s)^(.*?\r\n\r\n)", 1)) + F.octet_length("_h") - F.length("_h") + field("Content-Length", "([0-9]+)").cast("long") + 4).alias("_told"),
    )
    sound = (F.col("payload_digest") == F.col("_digest")) & (F.col("_size") == F.col("_told"))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not match its headers")).cast("string"))
    return parsed.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM w
"""
