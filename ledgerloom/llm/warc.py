"""Content-addressed WARC archive.

An archive is a folder of two tables. `payloads` holds every distinct payload once under its SHA-256; `headers` holds the
exact header bytes of every record and the digest of its payload. A payload only ever shuffles as the first copy of its
digest in each task. On writing, payloads of one digest must agree in SHA-1 and length; on reading, the stored bytes must
give the digest again. Joining both tables gives the original records back; a header alone is a valid revisit record.

The record with the smallest id of those with equal payloads of at least `least` bytes is the response, the others
revisit it; payloads below `least` are all responses (stored once all the same).

Defined results: a null payload is empty; a null id comes after all others; rows that repeat an id are records of their
own, the first one stored goes first; line breaks in urls are written as %0D and %0A; other columns are ignored; an
empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import read, stored
from ledgerloom.session import scratch

#: Fixed date of the records: an archive of the same pages has the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32(hex40: Column) -> Column:
    """RFC 4648 base32 of 20 bytes given as 40 hex digits: five digits make four letters."""
    quads = [F.lpad(F.conv(F.substring(hex40, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _header(revisit: Column) -> Column:
    """The header block with its closing empty line, as bytes."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    common = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(DATE)), F.coalesce(line("WARC-Target-URI", F.col("uri")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
    )
    refers = F.concat(
        line("WARC-Refers-To", _record_id(F.col("first.page_id"), F.col("first.row"))), F.coalesce(line("WARC-Refers-To-Target-URI", F.col("first.uri")), F.lit("")),
        line("WARC-Profile", F.lit(PROFILE)), line("Content-Length", F.lit("0")),
    )
    plain = F.concat(line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("bytes").cast("string")))
    return F.concat(common, F.when(revisit, refers).otherwise(plain), F.lit(CRLF)).cast("binary")


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    uri = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(page_id).alias("page_id"), uri.alias("uri"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    # narrow and written once: the number of a row is drawn only here
    facts = stored(
        rows.select("page_id", "uri", digest, base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")),
        "warc-facts",
    )
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row", "uri")
    groups = facts.groupBy("digest").agg(F.min(order).alias("first"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("sha1", "bytes")])
    same = F.assert_true((F.col("min_sha1") == F.col("max_sha1")) & (F.col("min_bytes") == F.col("max_bytes")), F.lit("two payloads of one SHA-256"))
    groups = groups.filter(same.isNull()).select("digest", "first")
    revisit = (F.col("bytes") >= least) & (F.col("row") != F.col("first.row"))
    headers = facts.join(groups, "digest").select(_record_id(F.col("page_id"), F.col("row")).alias("record_id"), _header(revisit).alias("header"), "digest")
    headers.write.parquet(f"{folder}/headers", compression="zstd")
    rows.select(digest, "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads", compression="zstd")


def field(header: Column, name: str) -> Column:
    """Value of a header line, null if there is none."""
    found = F.regexp_extract(header.cast("string"), rf"\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, header, payload, record) of every record: record is the bytes it has in a WARC file, payload the full payload, also of revisits."""
    stored_ = spark.read.parquet(f"{folder}/payloads")
    verified = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("stored payload does not give its digest")).cast("binary"))
    payloads = stored_.select("digest", verified.alias("payload"))
    both = spark.read.parquet(f"{folder}/headers").join(payloads, "digest")
    body = F.when(F.contains(F.col("header"), F.lit(b"\r\nWARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    return both.select("record_id", "header", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    records = read_archive(spark, folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d*):", 1).try_cast("long")
    header = F.col("header")
    return records.select(
        number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"), number(field(header, "WARC-Refers-To")).alias("refers_to"),
    )


OP4_SQL = """
WITH t AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages)
SELECT page_id, octet_length(encode(b)) AS payload_bytes,
array_to_string(list_transform(range(8), lambda i: translate(to_base(('0x' || substr(h, 1 + 5 * i, 5))::BIGINT, 32, 4), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM t
"""
