"""Queries over states and evidence: coverage, precedence, summaries, reconciliation, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from lustrate.functions.digests import digest
from lustrate.operators import detect, evidence
from lustrate.plans.text_queries import CARD_OF_X, EMAIL, RE_EMAIL, SQL_STATES, STANDARD, documents, sanitized

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


SQL_COVERAGE = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'FULL' WHEN doc_id % 3 = 1 THEN 'NONE' ELSE 'UNKNOWN' END AS attachments FROM documents"""


def covered(spark, sf_dir):
    turn = F.pmod("doc_id", F.lit(3))
    return documents(spark, sf_dir).select("doc_id", F.when(turn == 0, F.lit("FULL")).when(turn == 1, F.lit("NONE")).otherwise(F.lit("UNKNOWN")).alias("attachments"))


@query(f"SELECT doc_id, sha256('coverage.v1|content_text=FULL|structured_fields=NONE|metadata=NONE|embedded_objects=NONE|attachments=' || attachments) AS coverage_hash FROM ({SQL_COVERAGE})")
def coverage_hash(spark, sf_dir):
    none = F.lit("NONE")
    surfaces = {"content_text": F.lit("FULL"), "structured_fields": none, "metadata": none, "embedded_objects": none, "attachments": F.col("attachments")}
    return covered(spark, sf_dir).select("doc_id", evidence.coverage_hash(surfaces).alias("coverage_hash"))


@query(f"SELECT doc_id, CASE WHEN attachments = 'UNKNOWN' THEN 'UNKNOWN_COVERAGE' END AS reason_code FROM ({SQL_COVERAGE})")
def unknown_coverage(spark, sf_dir):
    return covered(spark, sf_dir).select("doc_id", evidence.reason_of((F.col("attachments") == "UNKNOWN", "UNKNOWN_COVERAGE")).alias("reason_code"))


# Injected faults give every reason a share of the documents, several at once on some.
SQL_REASON = f"""SELECT doc_id, text, text_out, n_card, n_email, n_ip, n_findings, CASE WHEN strlen(text) > 8192 THEN 'LIMIT_EXCEEDED' WHEN doc_id % 11 = 0 THEN 'UNSUPPORTED_FORMAT' WHEN doc_id % 13 = 0 THEN 'PARSE_ERROR'
  WHEN doc_id % 7 = 0 THEN 'UNKNOWN_COVERAGE' WHEN residual THEN 'VERIFICATION_FAILED' END AS reason_code FROM ({SQL_STATES})"""


def judged(spark, sf_dir):
    rows = sanitized(spark, sf_dir)
    every = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    reason = evidence.reason_of(
        (F.octet_length("text") > 8192, "LIMIT_EXCEEDED"), (every(11), "UNSUPPORTED_FORMAT"), (every(13), "PARSE_ERROR"),
        (every(7), "UNKNOWN_COVERAGE"), (F.col("residual"), "VERIFICATION_FAILED"),
    )
    return rows.withColumn("reason_code", reason).withColumn("state", evidence.state_of(F.col("reason_code")))


@query(f"SELECT doc_id, reason_code, CASE WHEN reason_code IS NULL THEN 'VERIFIED' ELSE 'QUARANTINED' END AS state FROM ({SQL_REASON})")
def quarantine_reason_precedence(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "reason_code", "state")


@query(f"""SELECT artifact_id, class_id, severity, action, CAST(sum(n) AS BIGINT) AS count FROM (
  SELECT sha256(text) AS artifact_id, unnest(['PII.Card', 'PII.Email', 'PII.Ip']) AS class_id, 'HIGH' AS severity, unnest(['MASK', 'REDACT', 'DROP']) AS action, unnest([n_card, n_email, n_ip]) AS n
  FROM ({SQL_REASON}) WHERE reason_code IS NULL) GROUP BY ALL HAVING sum(n) > 0""")
def findings_summary(spark, sf_dir):
    """Only verified artifacts have findings."""
    clean = judged(spark, sf_dir).where("state = 'VERIFIED'")
    parts = [F.struct(F.lit(c.class_id).alias("class_id"), F.lit(c.severity).alias("severity"), F.lit(c.action).alias("action"), F.col(f"n_{c.class_id.split('.')[-1].lower()}").alias("n")) for c in STANDARD.classes]
    return evidence.findings_summary(clean.select(digest(F.col("text")).alias("artifact_id"), F.inline(F.array(*parts))))


@query(f"SELECT count(*) AS artifacts_discovered, count(*) FILTER (reason_code IS NULL) AS artifacts_verified, count(*) FILTER (reason_code IS NOT NULL) AS artifacts_quarantined FROM ({SQL_REASON})")
def run_totals(spark, sf_dir):
    return evidence.run_totals(judged(spark, sf_dir))


@query(f"SELECT reason_code, count(*) AS count FROM ({SQL_REASON}) WHERE reason_code IS NOT NULL GROUP BY reason_code")
def reason_histogram(spark, sf_dir):
    return evidence.reason_histogram(judged(spark, sf_dir))


@query(f"""WITH hits AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '{EMAIL}'), list_transform(list_filter(regexp_extract_all(text, '[0-9 -]+'), lambda x: {CARD_OF_X}), lambda x: regexp_replace(x, '[^0-9]', '', 'g')))) AS v FROM documents)
SELECT doc_id, list_sort(list(DISTINCT sha256('key' || v))) AS proof_tokens FROM hits GROUP BY doc_id""")
def proof_token_sets(spark, sf_dir):
    """Keyed digests of what was found: of the match, and of the digits alone for cards."""
    text = F.col("text")
    values = F.concat(detect.matches(text, RE_EMAIL), F.transform(detect.matches(text, STANDARD.classes[0].detectors[0]), detect.digits))
    hits = documents(spark, sf_dir).select("doc_id", F.explode(values).alias("value"))
    return evidence.token_sets(hits.select("doc_id", digest(F.concat(F.lit("key"), "value")).alias("token")), "doc_id")


SQL_LEDGER = """SELECT doc_id, sha256(text) AS artifact_id, sha256('docs/' || doc_id) AS source_locator_hash, strlen(text) AS size_bytes, 'TEXT' AS artifact_type,
  CASE WHEN doc_id % 5 = 0 THEN 'QUARANTINED' ELSE 'VERIFIED' END AS state, CASE WHEN doc_id % 5 = 0 THEN 'PARSE_ERROR' END AS quarantine_reason_code, CASE WHEN doc_id % 5 <> 0 THEN sha256('out' || text) END AS output_id FROM documents"""


def ledger(spark, sf_dir):
    bad = F.pmod("doc_id", F.lit(5)) == 0
    return documents(spark, sf_dir).select(
        "doc_id", digest(F.col("text")).alias("artifact_id"), digest(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))).alias("source_locator_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.lit("TEXT").alias("artifact_type"), F.when(bad, F.lit("QUARANTINED")).otherwise(F.lit("VERIFIED")).alias("state"),
        F.when(bad, F.lit("PARSE_ERROR")).alias("quarantine_reason_code"), F.when(~bad, digest(F.concat(F.lit("out"), "text"))).alias("output_id"),
    )


@query(f"SELECT artifact_id, min(source_locator_hash) AS source_locator_hash, arg_min(size_bytes, source_locator_hash) AS size_bytes, arg_min(doc_id, source_locator_hash) AS doc_id FROM ({SQL_LEDGER}) GROUP BY artifact_id")
def ledger_upsert_first_wins(spark, sf_dir):
    return evidence.first_wins(ledger(spark, sf_dir).select("artifact_id", "source_locator_hash", "size_bytes", "doc_id"))


SQL_DRIFT = f"""SELECT source_locator_hash AS id, * REPLACE (CASE WHEN doc_id % 17 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN doc_id % 19 = 0 THEN 'CSV' ELSE artifact_type END AS artifact_type)
FROM ({SQL_LEDGER}) WHERE doc_id % 23 <> 0"""


def drifted(spark, sf_dir):
    """Evidence with injected drift: rows missing, sizes and types changed."""
    every = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    return ledger(spark, sf_dir).where(~every(23)).withColumns({
        "size_bytes": F.when(every(17), F.col("size_bytes") + 1).otherwise(F.col("size_bytes")), "artifact_type": F.when(every(19), F.lit("CSV")).otherwise(F.col("artifact_type")),
    })


@query(f"""SELECT l.source_locator_hash AS id, CASE WHEN e.id IS NULL THEN 'missing' ELSE 'different' END AS problem,
  CASE WHEN e.id IS NOT NULL THEN concat_ws(',', CASE WHEN l.size_bytes <> e.size_bytes THEN 'size_bytes' END, CASE WHEN l.artifact_type <> e.artifact_type THEN 'artifact_type' END) END AS fields
FROM (SELECT * FROM ({SQL_LEDGER}) WHERE doc_id % 29 <> 0) l LEFT JOIN ({SQL_DRIFT}) e ON l.source_locator_hash = e.id WHERE e.id IS NULL OR l.size_bytes <> e.size_bytes OR l.artifact_type <> e.artifact_type
UNION ALL SELECT id, 'extra', NULL FROM ({SQL_DRIFT}) WHERE doc_id % 29 = 0""")
def reconcile_full_outer(spark, sf_dir):
    own = ledger(spark, sf_dir).where(F.pmod("doc_id", F.lit(29)) != 0).withColumn("id", F.col("source_locator_hash"))
    return evidence.reconcile(own, drifted(spark, sf_dir).withColumn("id", F.col("source_locator_hash")), "id")


def expected(spark, sf_dir):
    return ledger(spark, sf_dir).where("state = 'VERIFIED'").select(F.concat("source_locator_hash", F.lit("__"), "artifact_id", F.lit(".txt")).alias("path"), "output_id", "doc_id")


def on_disk(spark, sf_dir):
    """The files of a tampered pack: some are gone, some are there that should not be."""
    rows = ledger(spark, sf_dir).where(F.pmod("doc_id", F.lit(31)) != 0)
    name = F.concat("source_locator_hash", F.lit("__"), "artifact_id", F.lit(".txt"))
    return rows.select(name.alias("path"))


SQL_PATH = "source_locator_hash || '__' || artifact_id || '.txt' AS path"


@query(f"SELECT {SQL_PATH} FROM ({SQL_LEDGER}) WHERE state <> 'VERIFIED' AND doc_id % 31 <> 0")
def verify_unexpected_outputs(spark, sf_dir):
    return on_disk(spark, sf_dir).join(expected(spark, sf_dir), "path", "left_anti").select("path")


@query(f"SELECT {SQL_PATH} FROM ({SQL_LEDGER}) WHERE state = 'VERIFIED' AND doc_id % 31 = 0")
def verify_missing_outputs(spark, sf_dir):
    return expected(spark, sf_dir).join(on_disk(spark, sf_dir), "path", "left_anti").select("path")


@query(f"SELECT {SQL_PATH}, doc_id FROM ({SQL_LEDGER}) WHERE state = 'VERIFIED' AND doc_id % 31 <> 0 AND CASE WHEN doc_id % 37 = 0 THEN sha256('x') ELSE output_id END <> output_id")
def verify_hash_mismatch(spark, sf_dir):
    found = documents(spark, sf_dir).where(F.pmod("doc_id", F.lit(31)) != 0).select(F.col("doc_id").alias("_id"), F.when(F.pmod("doc_id", F.lit(37)) == 0, digest(F.lit("x"))).otherwise(digest(F.concat(F.lit("out"), "text"))).alias("found_id"))
    return expected(spark, sf_dir).join(found, F.col("doc_id") == F.col("_id")).where("found_id <> output_id").select("path", "doc_id")


@query(f"""SELECT stage, count(*) AS failures FROM (SELECT CASE WHEN doc_id % 41 = 0 THEN 'safety' WHEN doc_id % 37 = 0 THEN 'hash' WHEN regexp_matches(text, '{EMAIL}') THEN 'residual' END AS stage FROM documents) WHERE stage IS NOT NULL GROUP BY stage""")
def verify_fail_stage(spark, sf_dir):
    """One tick a row at most: the first check that fails ends the others."""
    every = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    stage = evidence.fail_stage(every(41), every(37), detect.found(F.col("text"), RE_EMAIL))
    return documents(spark, sf_dir).select(stage.alias("stage")).where("stage IS NOT NULL").groupBy("stage").agg(F.count("*").alias("failures"))


@query(f"SELECT doc_id, artifact_id FROM ({SQL_LEDGER}) WHERE doc_id % 3 <> 0")
def resume_anti_join(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    done = rows.where(F.pmod("doc_id", F.lit(3)) == 0)
    return evidence.unfinished(rows, done, ["artifact_id", "source_locator_hash"]).select("doc_id", "artifact_id")


@query(f"""SELECT doc_id, '{{"artifact_id":"' || artifact_id || '","source_locator_hash":"' || source_locator_hash || '","size_bytes":' || size_bytes || ',"artifact_type":"TEXT","state":"' || state || '"'
  || CASE WHEN quarantine_reason_code IS NOT NULL THEN ',"quarantine_reason_code":"' || quarantine_reason_code || '"' ELSE '' END || CASE WHEN output_id IS NOT NULL THEN ',"output_id":"' || output_id || '"' ELSE '' END || '}}' AS line FROM ({SQL_LEDGER})""")
def evidence_records(spark, sf_dir):
    """Optional fields are left out where they are absent."""
    names = ["artifact_id", "source_locator_hash", "size_bytes", "artifact_type", "state", "quarantine_reason_code", "output_id"]
    return ledger(spark, sf_dir).select("doc_id", F.to_json(F.struct(*names), {"ignoreNullFields": "true"}).alias("line"))


@query(f"""SELECT '{{"artifact_id":"' || artifact_id || '","source_locator_hash":"' || source_locator_hash || '","reason_code":"' || quarantine_reason_code || '"}}' AS line FROM ({SQL_LEDGER}) WHERE state = 'QUARANTINED' ORDER BY artifact_id, source_locator_hash""")
def quarantine_index(spark, sf_dir):
    rows = ledger(spark, sf_dir).where("state = 'QUARANTINED'").orderBy("artifact_id", "source_locator_hash")
    return rows.select(F.to_json(F.struct("artifact_id", "source_locator_hash", F.col("quarantine_reason_code").alias("reason_code"))).alias("line"))


@query(f"SELECT artifact_id, count(*) AS count FROM ({SQL_LEDGER}) GROUP BY artifact_id HAVING count(*) > 1")
def duplicate_artifacts(spark, sf_dir):
    return evidence.duplicates(ledger(spark, sf_dir))
