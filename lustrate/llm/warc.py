r"""WARC archives with revisit records resolved by payload digest.

Headers (digest, length, page id; no payloads) are shuffled by digest. Of equal payloads the record
with the largest page id stays a response; the others become revisit records, without a payload,
that refer to it. Archives are written by Spark's own text sink with fresh headers, one record per
row, so a task lost half-way leaves nothing behind (the sink commits whole tasks). Each archive
starts its records with a header that names a fresh random id; this is the line separator by which
Spark splits archives of any size again, and ``Content-Length`` is checked on every record read.

Results for odd input: a null payload is empty; empty payloads are payloads like others (see
``least``); a null page id gives the record a name made of its digest and URL, is null again when
read, and never becomes another record's original unless all of its copies lack one, in which case
all stay responses; rows that share the largest page id and the payload all stay responses; a very
long payload is one record like others; control letters and blanks of a URL are written by their
codes; an empty table gives archives without records; other columns are passed over.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustrate.scratch import Scratch, small

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Bytes of the table of repeated digests that may be broadcast; a larger one is shuffled.
REPEATS_BYTES = 8 << 20
#: The capture date of written records; a parameter, so that runs can be repeated.
DATE = "2024-05-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 4 times 40 bits, 5 bits a letter."""
    digest = F.sha1(payload)
    letters = []
    for part in range(4):
        bits = F.conv(F.substring(digest, part * 10 + 1, 10), 16, 10).cast("bigint")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*letters)


def resolve_revisits(records: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """``records`` (page_id, digest, payload_bytes, ...) plus ``original``: the page id of the
    response that a revisit refers to, null for responses. Payloads under ``least`` bytes never revisit."""
    repeats = (
        records.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1 AND _keep IS NOT NULL").drop("_n")
    )
    repeats = small(scratch.save(repeats, "repeats"), 96, REPEATS_BYTES)
    joined = records.join(repeats, ["digest", "payload_bytes"], "left")
    return joined.withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("_keep")), F.col("_keep"))).drop("_keep")


def record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, mark: str, scratch: Scratch, least: int = 0) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC/1.1 files below ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})
    rows = resolve_revisits(rows, scratch, least)
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    revisit = F.col("original").isNotNull()
    # A URL must not break out of its header line; each such letter keeps a code of its own.
    unsafe = [chr(code) for code in (*range(0x21), 0x7F)]
    escaped = reduce(lambda url, letter: F.replace(url, F.lit(letter), F.lit(f"%{ord(letter):02X}")), unsafe, F.col("url"))
    target = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), escaped).otherwise(F.col("url"))
    # A record without a page id is named by what it holds.
    unnamed = F.concat(F.lit("<urn:sha1:"), "digest", F.lit(":"), F.hex(F.xxhash64("url")), F.lit(">"))
    body = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {mark}{CRLF}"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.coalesce(record_name(F.col("page_id")), unnamed)),
        F.lit(f"WARC-Date: {DATE}{CRLF}"),
        field("WARC-Target-URI", target),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", record_name(F.col("original"))),
        F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def read_archives(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Records of archives that ``write_archives`` wrote: type, page_id, original, digest, url, payload."""
    text = spark.read.option("lineSep", f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {mark}{CRLF}").text(path).where("value <> ''")
    cut = F.instr("value", CRLF * 2)
    parts = text.select(F.expr(f"substring(value, 1, instr(value, '{CRLF * 2}') + 1)").alias("head"), F.substring("value", cut + 4, F.length("value")).alias("rest"))
    field = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    page = lambda name: F.expr("nullif(_, '')".replace("_", f"regexp_extract(head, '(?:^|\\r\\n){name}: <urn:page:(-?[0-9]+)>', 1)")).cast("long")
    rows = parts.select(
        field("WARC-Type").alias("record_type"), page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("original"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), field("WARC-Target-URI").alias("url"),
        field("Content-Length").cast("long").alias("length"), "rest",
    )
    whole = F.octet_length("rest") == F.col("length") + 4
    block = F.when(whole, F.expr("left(rest, length(rest) - 4)")).otherwise(F.raise_error(F.lit("a record's length differs from its Content-Length")))
    return rows.withColumn("block", block).select(
        "record_type", "page_id", "original", "digest", "url", F.substring("block", F.instr("block", CRLF * 2) + 4, F.length("block")).alias("payload")
    )


#: Of equal payloads the record with the largest page id is the response; base32 takes 20 bits, four letters, at a time.
OP5_SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM p"""


def op5_warc_revisits(spark, sf_dir):
    """Writes every page as a WARC record, reads the archives back and reports each record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    scratch, mark = Scratch(spark, "warc"), f"<urn:uuid:{uuid.uuid4()}>"
    write_archives(pages, scratch.path("archives"), mark, scratch)
    read = read_archives(spark, scratch.path("archives"), mark)
    rows = read.select(
        "page_id", "record_type", "original", F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "response", base32_sha1(F.col("payload").cast("binary"))).otherwise(F.col("digest")).alias("payload_digest"),
    )
    rows = scratch.save(rows, "records")
    scratch.drop("archives", "repeats")
    # A revisit's length is that of the original it refers to.
    cited = rows.where("record_type = 'revisit'").select(F.col("original").alias("_id")).distinct()
    originals = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes")).join(cited, "_id", "left_semi")
    originals = small(scratch.save(originals, "originals"), 96, REPEATS_BYTES)
    joined = rows.join(originals, (F.col("original") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to"))
