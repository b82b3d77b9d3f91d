r"""Queries that write archives, mail and markup from tables and read them through the extractors."""

from __future__ import annotations

import base64
import io
import quopri
import struct
import zipfile
import zlib
from collections import namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustrate.functions import arrow
from lustrate.plans.policy import Limits
from lustrate.scratch import dealt
from lustrate.sources import extract

QUERIES, ORACLE_SQL = {}, {}
ARTIFACT = "artifact_id string, source_locator_hash string, artifact_type string, size_bytes long, content binary"
ARTIFACT_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(rows: DataFrame, key: str, pack: Callable) -> DataFrame:
    """``rows`` as the files of a corpus; ``pack`` gives each row's type and content."""

    def run(batches):
        for part in arrow.parts(batches):
            named = namedtuple("Row", part.schema.names)
            files = ((str(getattr(r, key)), *pack(r)) for r in map(named._make, arrow.rows_of(part, part.schema.names)))
            yield from arrow.in_batches(((i, "", kind, len(data), data) for i, kind, data in files), ARTIFACT_TYPES, [c.split()[0] for c in ARTIFACT.split(", ")])

    return rows.mapInArrow(run, ARTIFACT)


def zipped(entries: list[tuple[str, bytes]]) -> bytes:
    """A zip archive of stored files with plain names, as ``zipfile`` writes it."""
    heads, index, at = [], [], 0
    for name, data in entries:
        # Versions, flags, stored, 1980-01-01, CRC, sizes, length of the name, no extra field.
        what = struct.pack("<HHHIIIIHH", 20, 0, 0, 33 << 16, zlib.crc32(data), len(data), len(data), len(name), 0)
        heads += [b"PK\3\4", what, name.encode("ascii"), data]
        index += [b"PK\1\2", struct.pack("<H", 3 << 8 | 20), what, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), name.encode("ascii")]
        at += 30 + len(name) + len(data)
    size = sum(map(len, index))
    return b"".join([*heads, *index, b"PK\5\6", struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), size, at, 0)])


def tarred(entries: list[tuple[str, bytes]]) -> bytes:
    """A tar archive of files with plain names, as ``tarfile`` writes it but for the zeros after its end."""
    out = []
    for name, data in entries:
        head = b"%b0000644\0" b"0000000\0" b"0000000\0" b"%011o\0" b"00000000000\0" b"        " b"0%bustar\00000%b" % (name.encode("ascii").ljust(100, b"\0"), len(data), bytes(100), bytes(247))
        out += [head[:148], b"%06o\0 " % extract.byte_sum(head), head[156:], data, bytes(-len(data) % 512)]
    return b"".join([*out, bytes(1024)])


@query("""SELECT l_orderkey, CASE WHEN count(*) > 5 OR sum(CAST(floor(l_quantity) AS BIGINT)) > 120 THEN 'LIMIT_EXCEEDED' END AS reason_code,
  CASE WHEN count(*) > 5 OR sum(CAST(floor(l_quantity) AS BIGINT)) > 120 THEN 0 ELSE CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) END AS letters FROM lineitem GROUP BY l_orderkey""")
def archive_totals_guard(spark, sf_dir):
    """An archive for each order, with a file of as many letters as each line's quantity."""
    # A task for so many lines, however few pieces their file has; grouping needs no other exchange.
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", 200_000).groupBy("l_orderkey").agg(F.collect_list(F.floor("l_quantity").cast("int")).alias("sizes"))

    def pack(r):
        entries = [(f"{i}.txt", b"x" * n) for i, n in enumerate(r.sizes)]
        return ("ZIP", zipped(entries)) if r.l_orderkey % 2 else ("TAR", tarred(entries))

    records = extract.extract_records(packed(rows, "l_orderkey", pack), Limits(max_entries_per_archive=5, max_expanded_bytes_per_archive=120), texts=False)
    sums = records.groupBy("artifact_id").agg(F.max("reason").alias("reason_code"), F.coalesce(F.sum(F.length(F.get_json_object("record", "$.text"))), F.lit(0)).cast("long").alias("letters"))
    return sums.select(F.col("artifact_id").cast("long").alias("l_orderkey"), "reason_code", "letters")


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'UNSAFE_PATH' WHEN 2 THEN 'UNSAFE_PATH' WHEN 3 THEN 'UNSAFE_PATH' WHEN 4 THEN 'ENCRYPTED'
  WHEN 5 THEN 'LIMIT_EXCEEDED' WHEN 6 THEN 'UNSUPPORTED_FORMAT' ELSE 'PARSE_ERROR' END AS reason_code FROM part""")
def hostile_archives(spark, sf_dir):
    """One bad entry refuses its archive: paths that lead out, links, encryption, nesting, bytes that are no text, cut ends."""

    def pack(r):
        text, turn = [("good.txt", b"good")], r.p_partkey % 8
        if turn == 2:
            link = zipfile.ZipInfo("link")
            link.external_attr = 0o120777 << 16
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("good.txt", b"good")
                z.writestr(link, b"/etc/passwd")
            return "ZIP", out.getvalue()
        if turn == 4:
            data = bytearray(zipped(text))
            data[6] |= 1  # the flag of the local header, then that of the directory
            data[data.index(b"PK\1\2") + 8] |= 1
            return "ZIP", bytes(data)
        if turn == 5:
            for _ in range(3):
                text = [("inner.zip", zipped(text))]
        data = zipped(text + {1: [("a/../../b.txt", b"x")], 3: [("C:\\b.txt", b"x")], 6: [("b.bin", b"\xff\xfe")]}.get(turn, []))
        return "ZIP", data[:-30] if turn == 7 else data

    records = extract.extract_records(packed(dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 50_000), "p_partkey", pack), texts=False)
    return records.select(F.col("artifact_id").cast("long").alias("p_partkey"), F.col("reason").alias("reason_code"))


@query("""SELECT doc_id, n AS record_index, CASE n WHEN 0 THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS archive_depth, sha256(CASE n WHEN 0 THEN 'a.txt' WHEN 1 THEN 'x/1.txt' ELSE 'x/2.txt' END) AS entry_path_hash,
  CASE WHEN n > 0 THEN sha256('b/inner.tar') END AS container_path_hash, sha256(CASE n WHEN 0 THEN lang WHEN 1 THEN coalesce(text, '') ELSE source END) AS text_sha256
FROM (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest([CAST(0 AS BIGINT), 1, 2]) AS n FROM documents)""")
def nested_archives(spark, sf_dir):
    """Archives in archives: records in order of the paths, those of an inner archive in its place."""
    rows = table(spark, sf_dir, "documents").select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def pack(r):
        inner = tarred([("x/2.txt", r.source.encode()), ("x/./1.txt", r.text.encode())])
        return "ZIP", zipped([("b/inner.tar", inner), ("a.txt", r.lang.encode())])

    records = extract.extract_records(packed(rows, "doc_id", pack), texts=False)
    held = F.from_json("record", "archive_depth long, entry_path_hash string, container_path_hash string, text string")
    rows = records.select(F.col("artifact_id").cast("long").alias("doc_id"), "record_index", held.alias("r"))
    return rows.select("doc_id", "record_index", "r.archive_depth", "r.entry_path_hash", "r.container_path_hash", F.sha2("r.text", 256).alias("text_sha256"))


@query("""WITH m AS (SELECT conv_id * 100 + turn AS mail_id, role, text, unnest([CAST(0 AS BIGINT), 1, 2]) AS part FROM conversations)
SELECT mail_id, part, CASE WHEN part > 0 THEN sha256('eml/attach/' || (part - 1)) END AS attachment_locator_hash, CASE part WHEN 1 THEN sha256('näme.txt') WHEN 2 THEN sha256('files.zip') END AS filename_hash,
  CASE WHEN part = 2 THEN sha256('in.txt') END AS entry_path_hash, CASE WHEN part = 1 THEN 'ü ' || role ELSE text END AS text FROM m""")
def mail_attachments(spark, sf_dir):
    """Mail of a quoted-printable body, a text attachment in another charset, and a zipped one."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("mail_id"), "role", "text")

    def pack(r):
        note = base64.b64encode(f"ü {r.role}".encode("latin-1")).decode()
        archive = base64.encodebytes(zipped([("in.txt", r.text.encode())])).decode()
        parts = (
            "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(r.text.encode()).decode(),
            f"Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename*=utf-8''n%C3%A4me.txt\n\n{note}",
            f'Content-Type: application/zip\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename="files.zip"\n\n{archive}',
        )
        head = 'Subject: =?utf-8?q?caf=C3=A9?=\nContent-Type: multipart/mixed; boundary="=cut="\n\n'
        return "EML", (head + "".join(f"--=cut=\n{p}\n" for p in parts) + "--=cut=--\n").encode()

    records = extract.extract_records(packed(rows, "mail_id", pack), texts=False)
    held = F.from_json("record", "header_index long, body_index long, attachment_index long, attachment_locator_hash string, filename_hash string, entry_path_hash string, text string")
    rows = records.select(F.col("artifact_id").cast("long").alias("mail_id"), held.alias("r")).where("r.header_index IS NULL")
    return rows.select("mail_id", F.coalesce(F.col("r.attachment_index") + 1, F.lit(0)).cast("long").alias("part"), "r.attachment_locator_hash", "r.filename_hash", "r.entry_path_hash", "r.text")


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<(?:[^<>"'']|"[^"]*"|''[^'']*'')*>|[^<]+')) AS token, generate_subscripts(regexp_extract_all(html, '(?s)<!--.*?-->|<(?:[^<>"'']|"[^"]*"|''[^'']*'')*>|[^<]+'), 1) AS i FROM pages),
v AS (SELECT page_id, i, CASE WHEN starts_with(token, '<!--') THEN [] WHEN starts_with(token, '<') THEN regexp_extract_all(token, '=\s*"([^"]*)"', 1) ELSE [token] END AS found FROM t),
s AS (SELECT page_id, i, array_to_string(list_transform(list_filter(list_transform(found, lambda x: regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: x || chr(10)), '') AS line FROM v)
SELECT page_id, coalesce(string_agg(line, '' ORDER BY i), '') AS text FROM s GROUP BY page_id""")
def xml_text_extract(spark, sf_dir):
    """Text and attribute values of each page, one to a line."""

    def run(batches):
        for part in arrow.parts(batches):
            texts = pa.array([extract.xml_text(h or "") for h in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), texts], ["page_id", "text"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, text string")
