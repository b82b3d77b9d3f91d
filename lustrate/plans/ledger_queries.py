"""Queries over ledgers in transactions, many classes, dense spans and running totals, with their SQL."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from lustrate.functions.digests import digest
from lustrate.operators import class_table, detect, evidence, ordered, units
from lustrate.plans import engine
from lustrate.plans.evidence_queries import SQL_LEDGER
from lustrate.plans.evidence_queries import ledger as documents_ledger
from lustrate.plans.policy import Detector, Policy
from lustrate.plans.text_queries import EMAIL, IPV4, RE_EMAIL, RE_IPV4, SQL_SPANS, documents, one
from lustrate.scratch import Scratch, shared_dir
from lustrate.sources import ledger

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


#: Five hundred classes: a syllable and what follows it.
FIRST, VOWELS, LAST = "bdfghlmnrs", "aeiou", "bdglmnrstv"
SYLLABLES = [a + b + c for a in FIRST for b in VOWELS for c in LAST]
MANY = Policy(tuple(one(f"K.{s}", Detector("regex", f"{s}[a-z]+")) for s in SYLLABLES))


@query(f"""WITH k AS (SELECT a || b || c AS s FROM (SELECT unnest(string_split('{FIRST}', '')) AS a), (SELECT unnest(string_split('{VOWELS}', '')) AS b), (SELECT unnest(string_split('{LAST}', '')) AS c))
SELECT doc_id, 'K.' || s AS class_id, 'HIGH' AS severity, 'REDACT' AS action, n FROM (SELECT doc_id, s, CASE WHEN contains(text, s) THEN len(regexp_extract_all(text, s || '[a-z]+')) ELSE 0 END AS n FROM documents, k) WHERE n > 0""")
def many_classes(spark, sf_dir):
    """Five hundred classes over all documents: literals in one pass, a join, then the patterns that may match."""
    return class_table.class_counts(documents(spark, sf_dir).select("doc_id", "text"), MANY)


WORDS, PAIRS = "[a-z]+", "[a-z] [A-Z]"
#: Places of many matches by a window over their lengths.
SQL_DENSE = """SELECT doc_id, i, w, sum(gap + w) OVER (PARTITION BY doc_id ORDER BY i) - w AS s FROM (
  SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, {size}(unnest(hits)) AS w, {size}(unnest(gaps[1:len(hits)])) AS gap
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM documents WHERE regexp_matches(text, '{p}')))"""


@query(f"""SELECT doc_id, count(*) AS n_spans, CAST(min(s) AS BIGINT) AS first_byte, CAST(max(s + w) AS BIGINT) AS last_byte, CAST(sum(s * (i % 1000)) AS BIGINT) AS fold
FROM ({SQL_DENSE.format(size="strlen", p=WORDS)}) GROUP BY doc_id""")
def dense_spans_bytes(spark, sf_dir):
    """Byte places of every word: thousands of spans in a text."""
    spans = documents(spark, sf_dir).select("doc_id", F.posexplode(detect.byte_spans(F.col("text"), Detector("regex", WORDS))).alias("i", "s"))
    fold = F.sum(F.col("s.start").cast("long") * ((F.col("i") + 1) % 1000))
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.min("s.start").cast("long").alias("first_byte"), F.max("s.end").cast("long").alias("last_byte"), fold.alias("fold"))


@query(f"""WITH spans AS (SELECT doc_id, s, s + w AS e FROM (({SQL_DENSE.format(size="length", p=WORDS)}) UNION ALL ({SQL_DENSE.format(size="length", p=PAIRS)}))),
edges AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
islands AS (SELECT doc_id, s, e, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM edges),
merged AS (SELECT doc_id, island, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island)
SELECT doc_id, count(*) AS n_islands, CAST(sum(e - s) AS BIGINT) AS n_letters, CAST(sum(s * (island % 1000)) AS BIGINT) AS fold FROM merged GROUP BY doc_id""")
def dense_spans_merged(spark, sf_dir):
    """Union of two detectors' spans, thousands of them in a text."""
    pair = (Detector("regex", WORDS), Detector("regex", PAIRS))
    spans = documents(spark, sf_dir).select("doc_id", F.posexplode(detect.merged_spans(F.col("text"), pair)).alias("i", "s"))
    fold = F.sum(F.col("s.start").cast("long") * ((F.col("i") + 1) % 1000))
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_islands"), F.sum(F.col("s.end") - F.col("s.start")).alias("n_letters"), fold.alias("fold"))


#: Bytes that the folder of the query below may take: about half of the smallest tables.
FOLDER = 200_000


@query(f"""SELECT doc_id, CAST(running AS BIGINT) AS running, running > {FOLDER} AS over_limit, CASE WHEN running > {FOLDER} THEN 'LIMIT_EXCEEDED' END AS reason_code
FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY sha256(text), sha256('docs/' || doc_id) ROWS UNBOUNDED PRECEDING) AS running FROM documents)""")
def workdir_budget(spark, sf_dir):
    """Files past the folder limit, in the order of the listing."""
    files = documents_ledger(spark, sf_dir).select("doc_id", "artifact_id", "source_locator_hash", "size_bytes")
    judged = ordered.within_budget(files, engine.IDS, "size_bytes", FOLDER, Scratch(spark, "budget"))
    return judged.select("doc_id", "running", "over_limit", F.when(F.col("over_limit"), F.lit("LIMIT_EXCEEDED")).alias("reason_code"))


def fresh_pack(spark) -> Path:
    """A new folder that the driver and all executors share."""
    root = shared_dir(spark)
    if not root.startswith(("file:", "/")):
        raise ValueError("a pack needs a shared folder that is mounted")
    return Path(root.removeprefix("file://").removeprefix("file:")) / f"pack-{uuid.uuid4().hex}"


def artifact_rows(rows):
    covered = F.when(F.col("state") == "VERIFIED", digest(F.lit("coverage.v1|content_text=FULL|structured_fields=NONE|metadata=NONE|embedded_objects=NONE|attachments=NONE")))
    made = F.when(F.col("state") == "VERIFIED", F.lit("lustrate.text.v1"))
    return rows.select(*[c for c in ledger.names(ledger.TABLES["artifacts"]) if c not in ("extractor_id", "coverage_hash")], made.alias("extractor_id"), covered.alias("coverage_hash"))


@query(f"""SELECT doc_id, artifact_id FROM ({SQL_LEDGER}) WHERE doc_id % 3 <> 0""")
def resume_batches(spark, sf_dir):
    """A third of the documents is in a committed batch, a third was staged only: two thirds are left."""
    rows, pack = documents_ledger(spark, sf_dir), fresh_pack(spark)
    third = F.pmod("doc_id", F.lit(3))
    ledger.commit_batch(ledger.rows_of("artifacts", artifact_rows(rows.where(third == 0))), pack, 0)
    lost = pack / "evidence" / "ledger" / "artifacts" / "batch-1-0.parquet"
    artifact_rows(rows.where(third == 1)).write.parquet(f"file://{lost}")
    done = ledger.read(spark, pack, ledger.V2)["artifacts"]
    return evidence.unfinished(rows, done, engine.IDS).select("doc_id", "artifact_id")


@query(f"""WITH r AS (SELECT * FROM ({SQL_LEDGER})) SELECT 'v1' AS version, artifact_id, source_locator_hash, size_bytes, state, NULL::VARCHAR AS extractor_id, NULL::VARCHAR AS coverage_hash, 0::BIGINT AS n_tokens FROM r
UNION ALL SELECT 'v2', artifact_id, source_locator_hash, size_bytes, state, CASE WHEN state = 'VERIFIED' THEN 'lustrate.text.v1' END,
  CASE WHEN state = 'VERIFIED' THEN sha256('coverage.v1|content_text=FULL|structured_fields=NONE|metadata=NONE|embedded_objects=NONE|attachments=NONE') END, CASE WHEN state = 'VERIFIED' THEN 1 ELSE 0 END FROM r""")
def ledger_versions(spark, sf_dir):
    """The same documents in a ledger of each version, read as the present tables."""
    rows = documents_ledger(spark, sf_dir)
    old, new = fresh_pack(spark), fresh_pack(spark)
    folder = f"file://{old}/evidence/ledger"
    artifact_rows(rows).drop("extractor_id", "coverage_hash").write.parquet(f"{folder}/artifacts")
    spark.createDataFrame([], ledger.TABLES["findings_summary"]).write.parquet(f"{folder}/findings_summary")
    tokens = rows.where("state = 'VERIFIED'").select(*engine.IDS, F.lit(0).alias("token_index"), F.col("output_id").alias("token"))
    half = F.pmod("doc_id", F.lit(2))
    for batch in (0, 1):
        some = rows.where(half == batch)
        held = tokens.join(some.select(*engine.IDS), engine.IDS, "left_semi")
        ledger.commit_batch(ledger.rows_of("artifacts", artifact_rows(some)).unionByName(ledger.rows_of("proof_tokens", held)), new, batch)
    out = []
    for name, version, pack in (("v1", ledger.V1, old), ("v2", ledger.V2, new)):
        read = ledger.read(spark, pack, version)
        counts = read["proof_tokens"].groupBy(*engine.IDS).agg(F.count("*").alias("n"))
        columns = [F.lit(name).alias("version"), *engine.IDS, "size_bytes", "state", "extractor_id", "coverage_hash", F.coalesce("n", F.lit(0)).alias("n_tokens")]
        out.append(read["artifacts"].join(counts, engine.IDS, "left").select(*columns))
    return out[0].unionByName(out[1])


LOCATED = Policy((one("PII.Email", RE_EMAIL), one("PII.Ip", RE_IPV4)))


@query(f"""SELECT doc_id, 'PII.Email' AS class_id, 'json:pathhash:' || sha256('/text') || ':PII.Email:b' || CAST(s AS BIGINT) || ':' || CAST(s + w AS BIGINT) AS locator FROM ({SQL_SPANS.format(kind="'e'", size="strlen", p=EMAIL)})
UNION ALL SELECT doc_id, 'PII.Ip', 'json:pathhash:' || sha256('/text') || ':PII.Ip:b' || CAST(s AS BIGINT) || ':' || CAST(s + w AS BIGINT) FROM ({SQL_SPANS.format(kind="'i'", size="strlen", p=IPV4)})""")
def finding_locators(spark, sf_dir):
    """Locators of findings in JSON files of documents: the pointer's digest, the class and the byte span."""
    record = F.to_json(F.struct(F.col("lang"), F.col("text")))
    records = documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("artifact_id"), F.lit("").alias("source_locator_hash"), F.lit("JSON").alias("artifact_type"), F.lit(0).cast("long").alias("record_index"),
        F.lit("json").alias("kind"), record.alias("record"), F.lit(None).cast("string").alias("reason"),
    )
    found = engine.unit_findings(units.scan_units(records), LOCATED, b"key")
    return found.select(F.col("artifact_id").cast("long").alias("doc_id"), "class_id", "locator")
