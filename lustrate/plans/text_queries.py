r"""Queries over texts: scanning, identity, detection, rewriting. Each has SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from lustrate.functions.digests import digest, fold
from lustrate.operators import detect, rewrite
from lustrate.plans.policy import Detector, Policy, PolicyClass
from lustrate.scratch import spread

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"
RE_EMAIL, RE_IPV4, LUHN = Detector("regex", EMAIL), Detector("regex", IPV4), Detector("luhn")


def one(name: str, *detectors: Detector, action: str = "REDACT", keep_last: int = 0, selector=None, fields=()) -> PolicyClass:
    return PolicyClass(name, "HIGH", detectors, action, keep_last, selector, tuple(fields))


#: The flagship policy, in the order of its class ids.
STANDARD = Policy((
    one("PII.Card", LUHN, action="MASK", keep_last=4),
    one("PII.Email", RE_EMAIL),
    one("PII.Ip", RE_IPV4, action="DROP"),
))


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# DuckDB's side of the card rule: maximal runs of card letters, and the mod-10 sum by position.
SQL_CARD = """(length(regexp_replace({run}, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace({run}, '[^0-9]', '', 'g')) + 1),
  lambda i: CASE WHEN (length(regexp_replace({run}, '[^0-9]', '', 'g')) - i) % 2 = 0 THEN substr(regexp_replace({run}, '[^0-9]', '', 'g'), CAST(i AS BIGINT), 1)::INT
    ELSE (substr(regexp_replace({run}, '[^0-9]', '', 'g'), CAST(i AS BIGINT), 1)::INT * 2) // 10 + (substr(regexp_replace({run}, '[^0-9]', '', 'g'), CAST(i AS BIGINT), 1)::INT * 2) % 10 END)) % 10 = 0)"""
CARD_OF_X = SQL_CARD.format(run="x")
#: Documents with their merged card runs: pieces are runs of card letters or of others, in order.
SQL_PIECES = "regexp_extract_all(text, '[0-9 -]+|[^0-9 -]+')"
SQL_CARD_REWRITE = f"array_to_string(list_transform({SQL_PIECES}, lambda x: CASE WHEN regexp_full_match(x, '[0-9 -]+') AND {CARD_OF_X} THEN {{new}} ELSE x END), '')"
MASK4 = "repeat('*', greatest(length(x) - 4, 0)) || right(x, 4)"


@query("SELECT doc_id, length(text) AS n_text_chars, strlen(text) AS n_text_bytes, true AS valid, 'FULL' AS content_text, 'NONE' AS attachments FROM documents")
def scan_text_utf8(spark, sf_dir):
    raw = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("content"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(
        "doc_id", F.length(text).cast("long").alias("n_text_chars"), F.octet_length("content").cast("long").alias("n_text_bytes"),
        text.isNotNull().alias("valid"), F.lit("FULL").alias("content_text"), F.lit("NONE").alias("attachments"),
    )


@query("SELECT doc_id, sha256(text) AS artifact_id, sha256('docs/' || doc_id || '.txt') AS source_locator_hash FROM documents ORDER BY 2, 3")
def artifact_identity_sort(spark, sf_dir):
    ids = documents(spark, sf_dir).select("doc_id", digest(F.col("text")).alias("artifact_id"), digest(F.format_string("docs/%d.txt", "doc_id")).alias("source_locator_hash"))
    return ids.orderBy("artifact_id", "source_locator_hash")


@query("SELECT sha256(string_agg(id, '' ORDER BY id, loc)) AS input_corpus_id, count(*) AS artifacts FROM (SELECT sha256(text) AS id, sha256('docs/' || doc_id || '.txt') AS loc FROM documents)")
def corpus_id_fold(spark, sf_dir):
    # Ids come in sort order from Spark's range sort, partition by partition; no row or list holds the corpus.
    ids = artifact_identity_sort(spark, sf_dir).select("artifact_id")
    folded, n = fold(r["artifact_id"] and r["artifact_id"].encode() for r in ids.toLocalIterator())
    return spark.createDataFrame([(folded.hex(), n)], "input_corpus_id string, artifacts long")


def count_query(name: str, detector: Detector, sql_count: str) -> None:
    def run(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", detect.match_count(F.col("text"), detector).alias("n_findings"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql_count} AS n_findings FROM documents")(run)


count_query("detect_regex_email", RE_EMAIL, f"len(regexp_extract_all(text, '{EMAIL}'))")
count_query("detect_regex_ipv4", RE_IPV4, f"len(regexp_extract_all(text, '{IPV4}'))")
count_query("detect_luhn", LUHN, f"len(list_filter(regexp_extract_all(text, '[0-9 -]+'), lambda x: {CARD_OF_X}))")
count_query("detect_case_insensitive", Detector("regex", "(?Udiu)license|licencia|lizenz"), "len(regexp_extract_all(text, '(?i)license|licencia|lizenz'))")
count_query("detect_dotall", Detector("regex", "(?Uds)the.{1,3}of"), "len(regexp_extract_all(text, '(?s)the.{1,3}of'))")


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) + len(list_filter(regexp_extract_all(text, '[0-9 -]+'), lambda x: {CARD_OF_X}))
  + len(regexp_extract_all(text, '[0-9]+')) AS n_findings FROM documents""")
def detect_multi_detector_counts(spark, sf_dir):
    both = one("PII.Any", RE_EMAIL, LUHN, Detector("regex", "[0-9]+"))
    return documents(spark, sf_dir).select("doc_id", detect.class_count(F.col("text"), both).alias("n_findings"))


SQL_SPANS = """
  SELECT doc_id, {kind} AS detector, i, coalesce(list_sum(list_transform(gaps[1:i], lambda g: {size}(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: {size}(h))), 0) AS s,
         {size}(hits[i]) AS w
  FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM documents WHERE regexp_matches(text, '{p}')))
"""


@query(f"""SELECT doc_id, CAST(s AS INT) AS start_byte, CAST(s + w AS INT) AS end_byte, 'text:b' || CAST(s AS INT) || ':' || CAST(s + w AS INT) AS locator
FROM ({SQL_SPANS.format(kind="'email'", size="strlen", p=EMAIL)})""")
def finding_spans_bytes(spark, sf_dir):
    found = documents(spark, sf_dir).where(detect.found(F.col("text"), RE_EMAIL))
    rows = found.select("doc_id", F.explode(detect.byte_spans(F.col("text"), RE_EMAIL)).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start_byte"), F.col("s.end").alias("end_byte"), F.format_string("text:b%d:%d", "s.start", "s.end").alias("locator"))


@query(f"""WITH spans AS (SELECT doc_id, s, s + w AS e FROM (({SQL_SPANS.format(kind="'a'", size="length", p=EMAIL)}) UNION ALL ({SQL_SPANS.format(kind="'b'", size="length", p="[a-z]+[.][a-z]+")}))),
edges AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
islands AS (SELECT doc_id, s, e, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM edges)
SELECT doc_id, CAST(min(s) AS INT) AS start_char, CAST(max(e) AS INT) AS end_char FROM islands GROUP BY doc_id, island""")
def merge_spans(spark, sf_dir):
    pair = (RE_EMAIL, Detector("regex", "[a-z]+[.][a-z]+"))
    rows = documents(spark, sf_dir).select("doc_id", F.explode(detect.merged_spans(F.col("text"), pair)).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


def rewrite_query(name: str, policy: Policy, sql_text: str) -> None:
    def run(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", rewrite.rewrite(F.col("text"), policy).alias("text_out"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql_text} AS text_out FROM documents")(run)


def sql_mask(text: str, pattern: str, keep: int) -> str:
    gap = f"regexp_split_to_array({text}, '{pattern}')"
    hits = f"regexp_extract_all({text}, '{pattern}')"
    return f"""CASE WHEN regexp_matches({text}, '{pattern}') THEN array_to_string(list_transform(range(1, len({gap}) + 1), lambda i: {gap}[i] || coalesce(
      CASE WHEN length({hits}[i]) <= {keep} THEN {hits}[i] ELSE repeat('*', length({hits}[i]) - {keep}) || right({hits}[i], {keep}) END, '')), '') ELSE {text} END"""


rewrite_query("redact_email", Policy((one("PII.Email", RE_EMAIL),)), f"regexp_replace(text, '(?:{EMAIL})+', '{{{{PII.Email}}}}', 'g')")
rewrite_query("redact_luhn", Policy((one("PII.Card", LUHN),)), SQL_CARD_REWRITE.format(new="'{{PII.Card}}'"))
rewrite_query("drop_ipv4", Policy((one("PII.Ip", RE_IPV4, action="DROP"),)), f"regexp_replace(text, '(?:{IPV4})+', '', 'g')")
rewrite_query("mask_ipv4_keep2", Policy((one("PII.Ip", RE_IPV4, action="MASK", keep_last=2),)), sql_mask("text", f"(?:{IPV4})+", 2))
rewrite_query("mask_short_match", Policy((one("Short", Detector("regex", "[0-9]{4}"), action="MASK", keep_last=4),)), sql_mask("text", "(?:[0-9]{4})+", 4))
rewrite_query("touching_matches_one_marker", Policy((one("Digit", Detector("regex", "[0-9]")),)), "regexp_replace(text, '[0-9]+', '{{Digit}}', 'g')")
# The second class finds the first one's marker: classes see what the classes before them left.
rewrite_query(
    "sequential_classes",
    Policy((one("A.Email", RE_EMAIL), one("B.Marker", Detector("regex", "A[.]Email"), action="DROP"), one("C.Ip", RE_IPV4))),
    f"regexp_replace(regexp_replace(regexp_replace(text, '(?:{EMAIL})+', '{{{{A.Email}}}}', 'g'), '(?:A[.]Email)+', '', 'g'), '(?:{IPV4})+', '{{{{C.Ip}}}}', 'g')",
)

@query(f"""WITH spans AS (SELECT doc_id, s, s + w AS e FROM (({SQL_SPANS.format(kind="'a'", size="length", p=EMAIL)}) UNION ALL ({SQL_SPANS.format(kind="'b'", size="length", p="[a-z]+[.][a-z]+")}))),
edges AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
islands AS (SELECT doc_id, s, e, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM edges),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island),
cuts AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER w AS before, lead(s) OVER w AS next FROM merged WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
parts AS (SELECT c.doc_id, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST(s - before AS BIGINT)) || '{{{{Any}}}}' || CASE WHEN next IS NULL THEN substr(text, CAST(e + 1 AS BIGINT)) ELSE '' END, '' ORDER BY s) AS t
  FROM cuts c JOIN documents d ON c.doc_id = d.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(t, text) AS text_out FROM documents d LEFT JOIN parts p ON d.doc_id = p.doc_id""")
def redact_merged_detectors(spark, sf_dir):
    policy = Policy((one("Any", RE_EMAIL, Detector("regex", "[a-z]+[.][a-z]+")),))
    return documents(spark, sf_dir).select("doc_id", rewrite.rewrite(F.col("text"), policy).alias("text_out"))


SQL_SANITIZED = f"""
  SELECT doc_id, text, len(list_filter(regexp_extract_all(text, '[0-9 -]+'), lambda x: {CARD_OF_X})) AS n_card, len(regexp_extract_all(text, '{EMAIL}')) AS n_email, len(regexp_extract_all(text, '{IPV4}')) AS n_ip,
         regexp_replace(regexp_replace({SQL_CARD_REWRITE.format(new=MASK4)}, '(?:{EMAIL})+', '{{{{PII.Email}}}}', 'g'), '(?:{IPV4})+', '', 'g') AS text_out
  FROM documents"""
SQL_STATES = f"""
  SELECT *, n_card + n_email + n_ip AS n_findings, regexp_matches(text_out, '{EMAIL}') OR regexp_matches(text_out, '{IPV4}')
    OR len(list_filter(regexp_extract_all(text_out, '[0-9 -]+'), lambda x: {CARD_OF_X})) > 0 AS residual FROM ({SQL_SANITIZED})"""


def sanitized(spark, sf_dir, policy: Policy = STANDARD):
    """Documents with counts by class, the rewritten text and whether it still holds anything."""
    counts = {f"n_{c.class_id.split('.')[-1].lower()}": detect.class_count(F.col("text"), c) for c in policy.classes}
    # A generator is a border that the optimiser moves no expression across: what is read several times
    # after it is evaluated once.
    rows = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", *[c.alias(n) for n, c in counts.items()], F.explode(F.array(rewrite.rewrite(F.col("text"), policy))).alias("text_out"))
    total = sum((F.col(n) for n in counts), F.lit(0).cast("long"))
    left = F.explode(F.array(detect.residual(F.col("text_out"), policy))).alias("residual")
    return rows.select("doc_id", "text", *counts, "text_out", total.alias("n_findings"), left)


@query(f"""SELECT doc_id, CASE WHEN residual THEN 'QUARANTINED' ELSE 'VERIFIED' END AS state, CASE WHEN residual THEN 'VERIFICATION_FAILED' END AS reason_code, n_findings,
  CASE WHEN NOT residual THEN sha256(text_out) END AS output_id FROM ({SQL_STATES})""")
def sanitize_documents(spark, sf_dir):
    """Flagship: detect, rewrite, re-verify, identify the output."""
    rows = sanitized(spark, sf_dir)
    clean = ~F.col("residual")
    return rows.select(
        "doc_id", F.when(clean, F.lit("VERIFIED")).otherwise(F.lit("QUARANTINED")).alias("state"), F.when(~clean, F.lit("VERIFICATION_FAILED")).alias("reason_code"),
        "n_findings", F.when(clean, digest(F.col("text_out"))).alias("output_id"),
    )


@query(f"SELECT doc_id, residual FROM ({SQL_STATES})")
def residual_verify(spark, sf_dir):
    return sanitized(spark, sf_dir).select("doc_id", "residual")


@query("SELECT doc_id, strlen(text) AS size_bytes, strlen(text) > 4096 AS over_limit, CASE WHEN strlen(text) > 4096 THEN 'LIMIT_EXCEEDED' END AS reason_code FROM documents")
def limits_bytes(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    return documents(spark, sf_dir).select("doc_id", size.alias("size_bytes"), (size > 4096).alias("over_limit"), F.when(size > 4096, F.lit("LIMIT_EXCEEDED")).alias("reason_code"))
