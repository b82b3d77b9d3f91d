r"""Queries over tables as CSV records, JSON trees, containers and mail."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lustrate.functions import arrow
from lustrate.functions.digests import digest
from lustrate.operators import detect, evidence, rewrite, tables, units
from lustrate.plans.policy import Detector, Limits, Policy
from lustrate.plans.text_queries import documents, one
from lustrate.scratch import Scratch, dealt
from lustrate.sources import extract, inventory

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""WITH named AS (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '.csv') AS path FROM pages),
ext AS (SELECT *, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.]\.([^.]+)$', 1)) AS e FROM named)
SELECT page_id, path, CASE e WHEN 'csv' THEN 'CSV' WHEN 'txt' THEN 'TEXT' WHEN 'json' THEN 'JSON' WHEN 'zip' THEN 'ZIP' END AS artifact_type,
  CASE e WHEN 'csv' THEN 'csv' WHEN 'txt' THEN 'txt' WHEN 'json' THEN 'json' WHEN 'zip' THEN 'ndjson' ELSE 'bin' END AS sanitized_extension,
  CASE e WHEN 'csv' THEN 'CSV' WHEN 'txt' THEN 'TEXT' WHEN 'json' THEN 'JSON' WHEN 'zip' THEN 'NDJSON' END AS verification_type, coalesce(e = 'zip', false) AS risky FROM ext""")
def classify_by_extension(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/$", ".csv")
    kind = inventory.artifact_type(F.col("path"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select(
        "page_id", "path", kind.alias("artifact_type"), inventory.output_extension(kind).alias("sanitized_extension"),
        inventory.verification_type(kind).alias("verification_type"), inventory.is_risky(kind).alias("risky"),
    )


DIGITS = Detector("regex", "[0-9]{3,}")
CUSTOMER = ["c_name", "c_mktsegment", "c_acctbal"]
SQL_CELLS = "(SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS field, unnest([c_name, c_mktsegment]) AS text FROM customer)"


def cells(spark, sf_dir, policy: Policy, key="c_custkey", name="customer", columns=("c_name", "c_mktsegment")):
    rows = tables.cell_units(table(spark, sf_dir, name), key, list(columns))
    (only,) = policy.classes
    hits = F.when(tables.applies()(only), detect.class_count(F.col("text"), only)).otherwise(F.lit(0).cast("long"))
    return rows.select(key, "field", hits.alias("n_findings"))


@query(f"SELECT c_custkey, field, CASE WHEN field = 'c_name' THEN len(regexp_extract_all(text, '[0-9]{{3,}}')) ELSE 0 END AS n_findings FROM {SQL_CELLS}")
def csv_selector_scan(spark, sf_dir):
    return cells(spark, sf_dir, Policy((one("Id", DIGITS, selector="csv_header", fields=["c_name"]),)))


@query(f"SELECT c_custkey, field, len(regexp_extract_all(text, '[0-9]{{3,}}')) AS n_findings FROM {SQL_CELLS}")
def csv_all_columns(spark, sf_dir):
    return cells(spark, sf_dir, Policy((one("Id", DIGITS),)))


@query(f"SELECT c_custkey, field, CAST(0 AS BIGINT) AS n_findings FROM {SQL_CELLS}")
def csv_selector_unmatched_header(spark, sf_dir):
    """A selector that names no header there is scans nothing."""
    return cells(spark, sf_dir, Policy((one("Id", DIGITS, selector="csv_header", fields=["no_such"]),)))


@query(f"SELECT c_custkey, field, len(regexp_extract_all(text, '[0-9]{{3,}}')) AS n_findings FROM {SQL_CELLS}")
def selector_kind_mismatch(spark, sf_dir):
    """A selector of JSON pointers is no filter for cells."""
    return cells(spark, sf_dir, Policy((one("Id", DIGITS, selector="json_pointer", fields=["/c_name"]),)))


@query("SELECT s_suppkey, regexp_replace(s_name, '(?:[0-9]{3,})+', '{{Id}}', 'g') AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def csv_cells_rewrite(spark, sf_dir):
    policy = Policy((one("Id", DIGITS, selector="csv_header", fields=["s_name"]),))
    return tables.rewrite_cells(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), ["s_name", "s_nationkey"], policy)


@query("SELECT i AS col_index, h AS header, CASE WHEN h = 'c_name' THEN regexp_replace(h, '(?:name)+', '{{Head}}', 'g') ELSE h END AS header_out FROM (SELECT unnest(['c_name', 'c_mktsegment', 'c_acctbal']) AS h, unnest([0, 1, 2]) AS i)")
def csv_header_rewrite(spark, sf_dir):
    """Headers are scanned and rewritten under their own column's selector."""
    policy = Policy((one("Head", Detector("regex", "name"), selector="csv_header", fields=["c_name"]),))
    heads = table(spark, sf_dir, "customer").select(*CUSTOMER).limit(1).select(F.posexplode(F.array(*[F.lit(c) for c in CUSTOMER])).alias("col_index", "header"))
    out = rewrite.rewrite(F.col("header"), policy, tables.applies(F.lit("csv_header"), F.col("header"), F.lit(None).cast("string")))
    return heads.select("col_index", "header", out.alias("header_out"))


# JSON objects of known shape: each leaf is a column with a pointer, so nothing leaves the JVM.
POINTERS = {"/meta/lang": "lang", "/meta/source": "source", "/text": "text"}


def leaf_units(spark, sf_dir):
    parts = F.array(*[F.struct(F.lit(p).alias("pointer"), F.col(c).alias("text")) for p, c in POINTERS.items()])
    return documents(spark, sf_dir).select("doc_id", F.lit("json_leaf").alias("unit_kind"), F.lit(None).cast("string").alias("field"), F.explode(parts).alias("u")).select("doc_id", "unit_kind", "field", "u.*")


SQL_LEAVES = "(SELECT doc_id, unnest(['/meta/lang', '/meta/source', '/text']) AS pointer, unnest([lang, source, text]) AS text FROM documents)"


def leaf_counts(spark, sf_dir, policy: Policy):
    (only,) = policy.classes
    hits = F.when(tables.applies()(only), detect.class_count(F.col("text"), only)).otherwise(F.lit(0).cast("long"))
    return leaf_units(spark, sf_dir).select("doc_id", "pointer", hits.alias("n_findings"))


@query(f"SELECT doc_id, pointer, CASE WHEN pointer = '/meta/source' THEN len(regexp_extract_all(text, '[0-9]+')) ELSE 0 END AS n_findings FROM {SQL_LEAVES}")
def json_pointer_leaf(spark, sf_dir):
    return leaf_counts(spark, sf_dir, Policy((one("N", Detector("regex", "[0-9]+"), selector="json_pointer", fields=["/meta/source"]),)))


@query(f"SELECT doc_id, pointer, CAST(0 AS BIGINT) AS n_findings FROM {SQL_LEAVES}")
def json_pointer_exact(spark, sf_dir):
    """A pointer is matched as a whole: that of the parent object selects none of its leaves."""
    return leaf_counts(spark, sf_dir, Policy((one("N", Detector("regex", "[0-9]+"), selector="json_pointer", fields=["/meta"]),)))


def tree_units(spark, sf_dir):
    tree = F.to_json(F.struct(F.col("text").alias("body text"), F.struct("lang", "n_chars").alias("a/b~c")))
    records = documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("artifact_id"), F.lit("").alias("source_locator_hash"), F.lit(0).cast("long").alias("record_index"),
        F.lit("json").alias("kind"), tree.alias("record"), F.lit(None).cast("string").alias("reason"),
    )
    return units.scan_units(records)


@query("""SELECT doc_id, p AS pointer, k AS text, k = 'lang' AS hit FROM (SELECT doc_id, unnest(['/a~1b~0c', '/a~1b~0c/lang', '/a~1b~0c/n_chars', '/body text']) AS p,
  unnest(['a/b~c', 'lang', 'n_chars', 'body text']) AS k FROM documents)""")
def json_key_detect(spark, sf_dir):
    """Keys are units too; they are scanned and never rewritten."""
    keys = tree_units(spark, sf_dir).where("unit_kind = 'json_key' AND NOT rewritable")
    return keys.select(F.col("artifact_id").cast("long").alias("doc_id"), "pointer", "text", detect.found(F.col("text"), Detector("regex", "^lang$")).alias("hit"))


@query("SELECT doc_id, '/a~1b~0c/lang' AS pointer FROM documents UNION ALL SELECT doc_id, '/body text' FROM documents")
def json_number_unscanned(spark, sf_dir):
    """Numbers are no units: ``n_chars`` has no leaf row."""
    return tree_units(spark, sf_dir).where("unit_kind = 'json_leaf'").select(F.col("artifact_id").cast("long").alias("doc_id"), "pointer")


ARTIFACT = ["artifact_id", "source_locator_hash", "artifact_type", "size_bytes", "content"]


def files(rows, key, kind: str, text):
    """Rows as the files of a corpus: ``text`` is what each holds, ``key`` its id."""
    content = text.cast("binary")
    return rows.select(F.col(key).cast("string"), F.lit(""), F.lit(kind), F.octet_length(content).cast("long"), content).toDF(*ARTIFACT)


def rebuilt_files(artifacts, policy: Policy, key: str):
    """Files extracted, cut into units, rewritten and put together again, as the engine does it."""
    records = Scratch(artifacts.sparkSession, "files").save(extract.extract_records(artifacts), "records")
    found = units.scan_units(records)
    changed = found.withColumn("text_out", F.when(F.col("rewritable"), rewrite.rewrite(F.col("text"), policy, tables.applies())).otherwise(F.col("text")))
    return units.assemble(units.rebuild_records(records, changed)).select(F.col("artifact_id").cast("long").alias(key), "output")


@query("""SELECT event_id, '{"event_type":"' || event_type || '","k":' || json_extract(props, '$.k') || ',"user_id":' || user_id || '}' AS canonical FROM events""")
def json_canonical(spark, sf_dir):
    """JSON files with blanks and keys in any order, extracted: keys sorted, no blanks."""
    text = F.format_string('{ "user_id" : %d,\n\t"k":%s , "event_type": "%s"}\n', "user_id", F.get_json_object("props", "$.k"), "event_type")
    records = extract.extract_records(files(table(spark, sf_dir, "events"), "event_id", "JSON", text))
    return records.select(F.col("artifact_id").cast("long").alias("event_id"), F.col("record").alias("canonical"))


@query(r"""SELECT conv_id, string_agg('{"meta":{"role":"' || regexp_replace(role, '(?:user)+', '{{Role}}', 'g') || '","user":' || turn || '},"words":' || len(regexp_extract_all(text, '[^ \n]+')) || '}' || chr(10), '' ORDER BY turn, role) AS output
FROM conversations GROUP BY conv_id""")
def ndjson_rewrite(spark, sf_dir):
    """Files of JSON lines (blank ones among them), with strings rewritten, numbers and keys left alone."""
    line = F.to_json(F.struct(F.regexp_count("text", F.lit(r"[^ \n]+")).alias("words"), F.struct(F.col("turn").alias("user"), "role").alias("meta")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("place"), F.concat(F.lit(" "), line, F.lit("\n")).alias("line"))
    whole = evidence.in_order(rows, "conv_id", "place", "line", "lines")
    return rebuilt_files(files(whole, "conv_id", "NDJSON", F.col("lines")), Policy((one("Role", Detector("regex", "user")),)), "conv_id")


NOTED = r"""SELECT s_nationkey, 's_suppkey{d}note{d}s_name' || chr(10) || string_agg(s_suppkey || '{d}' || {note} || '{d}' || regexp_replace(s_name, '(?:[0-9]{{3,}})+', '{{{{Id}}}}', 'g') || chr(10), '' ORDER BY s_suppkey) AS output
FROM supplier GROUP BY s_nationkey"""


def noted_files(spark, sf_dir, kind: str, delimiter: str):
    """A file of suppliers for each nation; the notes hold delimiters, quotes and line ends."""
    note = F.concat(F.lit('"No. 12345, ""so'), F.lit(delimiter), F.lit('called""\nof "'))
    line = F.concat_ws(delimiter, F.col("s_suppkey").cast("string"), note, F.concat(F.lit('"'), "s_name", F.lit('"')))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(line, F.lit("\r\n")).alias("line"))
    whole = evidence.in_order(rows, "s_nationkey", "s_suppkey", "line", "lines")
    text = F.concat(F.lit(delimiter.join(("s_suppkey", "note", "s_name")) + "\r\n"), "lines")
    policy = Policy((one("Id", DIGITS, selector="csv_header", fields=["s_name"]),))
    return rebuilt_files(files(whole, "s_nationkey", kind, text), policy, "s_nationkey").select(F.col("s_nationkey").cast("int"), "output")


@query(NOTED.format(d=",", note="""'"No. 12345, ""so,called""' || chr(10) || 'of "'"""))
def csv_file_rewrite(spark, sf_dir):
    """CSV files parsed, one column rewritten, and written with quotes only where cells need them."""
    return noted_files(spark, sf_dir, "CSV", ",")


@query(NOTED.format(d="\t", note="""'"No. 12345, ""so' || chr(9) || 'called""' || chr(10) || 'of "'""").replace("\t", "' || chr(9) || '"))
def tsv_file_rewrite(spark, sf_dir):
    return noted_files(spark, sf_dir, "TSV", "\t")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'PARSE_ERROR' END AS reason_code FROM part""")
def malformed_files(spark, sf_dir):
    """Broken CSV and JSON files end in a reason; a sound one in eight does not."""
    broken = ("a,b\n1,2\n", "a,b\n1\n", 'a,b\n"1,2\n', "", '{"a":1e400}', '{"a":NaN}', '{"a":"\\ud800"}', '{"a":1')
    turn = F.pmod("p_partkey", F.lit(8))
    text = F.element_at(F.array(*[F.lit(x) for x in broken]), (turn + 1).cast("int"))
    rows = files(dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 50_000), "p_partkey", "CSV", text).withColumn("artifact_type", F.when(F.pmod(F.col("artifact_id").cast("long"), F.lit(8)) < 4, F.lit("CSV")).otherwise(F.lit("JSON")))
    return extract.extract_records(rows, texts=False).select(F.col("artifact_id").cast("long").alias("p_partkey"), F.col("reason").alias("reason_code"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#65;', 'A'), '&amp;', '&') = xml AS same FROM
  (SELECT page_id, html, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS xml FROM pages)""")
def xml_entities(spark, sf_dir):
    def run(batches):
        for batch in batches:
            plain = batch["html"].fillna("")
            for name, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
                plain = plain.str.replace(f"&{name};", letter, regex=False)
            yield pd.DataFrame({"page_id": batch["page_id"], "same": [extract.xml_entities(h or "") == p for h, p in zip(batch["html"], plain)]})

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, same boolean")


@query(r"""WITH raw AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '..\' || p WHEN page_id % 4 = 1 THEN '/' || p WHEN page_id % 4 = 2 THEN './/' || p ELSE p END AS raw_path
  FROM (SELECT page_id, ltrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS p FROM pages)),
slashed AS (SELECT page_id, raw_path, replace(raw_path, '\', '/') AS s FROM raw),
parts AS (SELECT page_id, raw_path, s, list_filter(string_split(s, '/'), lambda x: x <> '' AND x <> '.') AS l FROM slashed),
safe AS (SELECT page_id, raw_path, CASE WHEN starts_with(s, '/') OR list_contains(l, '..') OR len(l) = 0 OR regexp_matches(s, '^[A-Za-z]:') THEN NULL ELSE array_to_string(l, '/') END AS entry_path FROM parts)
SELECT page_id, raw_path, entry_path, CASE WHEN entry_path IS NULL THEN 'UNSAFE_PATH' END AS reason_code, coalesce(entry_path LIKE '%.zip' OR entry_path LIKE '%.tar', false) AS nested FROM safe""")
def archive_path_normalize(spark, sf_dir):
    from lustrate.functions.paths import is_nested, safe_entry_path

    tail = F.ltrim(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("/"))
    turn = F.pmod("page_id", F.lit(4))
    raw = F.when(turn == 0, F.concat(F.lit("..\\"), tail)).when(turn == 1, F.concat(F.lit("/"), tail)).when(turn == 2, F.concat(F.lit(".//"), tail)).otherwise(tail)
    path = safe_entry_path(F.col("raw_path"))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw_path")).select("page_id", "raw_path", path.alias("entry_path"), F.when(path.isNull(), F.lit("UNSAFE_PATH")).alias("reason_code"), is_nested(path).alias("nested"))


@query(f"""WITH lines AS (SELECT o_orderkey, 'From user' || o_custkey || '@example.org ' || CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%a %b %d %H:%M:%S %Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%a %b %d %H:%M %Y')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS line FROM orders)
SELECT o_orderkey, line, regexp_full_match(line, '{extract.MBOX_SEPARATOR}') AS valid FROM lines""")
def mbox_separator_valid(spark, sf_dir):
    turn = F.pmod("o_orderkey", F.lit(3))
    when = lambda shape: F.date_format("o_orderdate", shape)
    date = F.when(turn == 0, when("EEE MMM dd HH:mm:ss yyyy")).when(turn == 1, when("EEE MMM dd HH:mm yyyy")).otherwise(when("yyyy-MM-dd"))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("From user"), F.col("o_custkey").cast("string"), F.lit("@example.org "), date).alias("line"))
    return lines.select("o_orderkey", "line", F.col("line").rlike(f"^(?:{extract.MBOX_SEPARATOR})\\z").alias("valid"))


@query("""WITH m AS (SELECT conv_id, role, text, row_number() OVER w - 1 AS i, CASE WHEN lead(turn) OVER w IS NULL THEN '' ELSE chr(10) END AS ends FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
SELECT conv_id, i AS message_index, 'header' AS part, CAST(0 AS BIGINT) AS part_index, 'X-Role: ' || role AS shown FROM m
UNION ALL SELECT conv_id, i, 'header', CAST(1 AS BIGINT), 'Content-Type: text/plain; charset=utf-8' FROM m
UNION ALL SELECT conv_id, i, 'body', CAST(0 AS BIGINT), sha256(substr(replace(chr(10) || text || ends, chr(10) || 'From ', chr(10) || '>From '), 2)) FROM m""")
def mail_records(spark, sf_dir):
    """A mailbox for each conversation, parsed to the records of its headers and bodies."""
    body = F.expr(r"substring(replace(concat('\n', text), '\nFrom ', '\n>From '), 2)")
    message = F.concat(F.lit("From a@example.org Mon Jan  1 00:00:00 2024\nX-Role: "), "role", F.lit("\nContent-Type: text/plain; charset=utf-8\n\n"), body)
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("place"), message.alias("message"))
    whole = evidence.in_order(rows, "conv_id", "place", "message", "box")
    records = extract.extract_records(files(whole, "conv_id", "MBOX", F.col("box")))
    held = F.from_json("record", "message_index long, header_index long, key string, value string, body_index long, text string")
    rows = records.select(F.col("artifact_id").cast("long").alias("conv_id"), held.alias("r"))
    header = F.col("r.key").isNotNull()
    return rows.select(
        "conv_id", "r.message_index", F.when(header, F.lit("header")).otherwise(F.lit("body")).alias("part"),
        F.coalesce("r.header_index", "r.body_index").alias("part_index"),
        F.when(header, F.concat("r.key", F.lit(": "), "r.value")).otherwise(digest(F.col("r.text"))).alias("shown"),
    )


def build(kind: str, text: str) -> bytes:
    """A small container that holds ``text``."""
    out = io.BytesIO()
    if kind in ("ZIP", "DOCX"):
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml" if kind == "DOCX" else "notes.txt", f"<w>[{text.replace('&', '&amp;').replace('<', '&lt;')}]</w>" if kind == "DOCX" else text)
    elif kind == "TAR":
        with tarfile.open(fileobj=out, mode="w") as t:
            info = tarfile.TarInfo("notes.txt")
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    else:
        body = text.encode()
        head = b"From a@example.org Mon Jan  1 00:00:00 2024\n" if kind == "MBOX" else b""
        body = (b"\n" + body).replace(b"\nFrom ", b"\n>From ")[1:] if kind == "MBOX" else body
        out.write(head + b"Subject: notes\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n" + body)
    return out.getvalue()


@query("""SELECT doc_id, k AS artifact_type, CASE WHEN k IN ('EML', 'MBOX') THEN CAST(4 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS records,
  sha256(CASE k WHEN 'DOCX' THEN '[' || t || ']' || chr(10) WHEN 'MBOX' THEN substr(replace(chr(10) || t, chr(10) || 'From ', chr(10) || '>From '), 2) ELSE t END) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(['ZIP', 'TAR', 'DOCX', 'EML', 'MBOX']) AS k FROM documents)""")
def container_round_trip(spark, sf_dir):
    """Every document in five kinds of containers, extracted again: the text is that put in."""
    kinds = ("ZIP", "TAR", "DOCX", "EML", "MBOX")

    def pack(batches):
        for part in arrow.parts(batches):
            rows = ((str(i), "", k, len(data := build(k, t or "")), data) for i, t in arrow.rows_of(part, ["doc_id", "text"]) for k in kinds)
            yield from arrow.in_batches(rows, [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()], ARTIFACT)

    packed = documents(spark, sf_dir).select("doc_id", "text").mapInArrow(pack, "artifact_id string, source_locator_hash string, artifact_type string, size_bytes long, content binary")
    # Deflated prose with long repeats can expand further than the default limit allows.
    records = extract.extract_records(packed, Limits(max_expansion_ratio=2000), texts=False).where("reason IS NULL")
    rows = records.groupBy("artifact_id", "artifact_type").agg(F.count("*").alias("records"), F.max(digest(F.get_json_object("record", "$.text"))).alias("text_sha256"))
    return rows.select(F.col("artifact_id").cast("long").alias("doc_id"), "artifact_type", "records", "text_sha256")
