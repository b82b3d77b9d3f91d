"""The verbs: run a corpus under a policy into a pack, verify a pack, lint a policy.

Exit codes: 0 clean, 1 fatal, 2 something quarantined or failing verification, 3 wrong use.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lustrate import __version__
from lustrate.functions.digests import blake3, digest, fold
from lustrate.operators import class_table, detect, evidence, ordered, rewrite, tables, units
from lustrate.plans import events
from lustrate.plans.policy import Limits, Policy, PolicyError, load_limits, load_policy
from lustrate.scratch import Scratch
from lustrate.sources import extract, inventory, ledger, listing, sinks

OK, FATAL, QUARANTINED, USAGE = 0, 1, 2, 3
IDS = ["artifact_id", "source_locator_hash"]
#: Pack versions that can be read; a pack of the first one differs in its ledger only.
PACKS = ("lustrate.pack.v1", "lustrate.pack.v2")
PACK, LEDGER = PACKS[-1], ledger.V2


class Fatal(RuntimeError):
    """A structural fault: nothing can be said about the content."""


def hashed(data: bytes, method: str) -> str:
    return (blake3(data) if method == "blake3" else hashlib.sha256(data).digest()).hex()


#: Names the purpose of the digests that the key of a run is made of.
SECRET = b"lustrate.corpus.secret"


def padded_key(key: bytes, pad: int) -> bytearray:
    return bytearray(b ^ pad for b in key.ljust(64, b"\0"))


def proof_token(value, inner, outer):
    """HMAC-SHA-256 of a found value; ``inner`` and ``outer`` are columns with the padded keys."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def unit_findings(found: DataFrame, policy: Policy, key: bytes, method: str = "sha2-256") -> DataFrame:
    """One row per finding of ``found`` (scan units): class, locator (place, class, byte span) and proof token.

    The key comes as a table of one row: literals would show up in plans and event logs."""
    keys = found.sparkSession.createDataFrame([(padded_key(key, 0x36), padded_key(key, 0x5C))], "_inner binary, _outer binary")
    rows = class_table.class_hits(found, policy).join(F.broadcast(keys), F.lit(True))
    place = F.concat_ws(":", "place", F.when(F.col("unit_kind").startswith("json"), F.concat(F.lit("pathhash:"), digest(F.col("pointer"), method))), "class_id", F.format_string("b%d:%d", "start", "end"))
    value = F.when(F.col("luhn"), detect.digits(F.col("hit"))).otherwise(F.col("hit"))
    return rows.select(*IDS, "class_id", "severity", "action", place.alias("locator"), proof_token(value, F.col("_inner"), F.col("_outer")).alias("token"))


def rewritten_units(found: DataFrame, policy: Policy) -> DataFrame:
    """``found`` with ``text_out``; long policies go through the units as a table."""
    if len(policy.classes) > rewrite.UNROLLED:
        out = class_table.rewrite_units(found, policy)
        return out.withColumn("text_out", F.when(F.col("rewritable"), F.col("text_out")).otherwise(F.col("text")))
    return found.withColumn("text_out", F.when(F.col("rewritable"), rewrite.rewrite(F.col("text"), policy, tables.applies())).otherwise(F.col("text")))


def with_residual(changed: DataFrame, policy: Policy, text: str = "text_out") -> DataFrame:
    if len(policy.classes) > rewrite.UNROLLED:
        return class_table.residual_units(changed, policy, text)
    return changed.withColumn("residual", detect.residual(F.col(text), policy, tables.applies()))


def sanitize(artifacts: DataFrame, policy: Policy, limits: Limits, method: str, scratch: Scratch, key: bytes = b"") -> tuple[DataFrame, DataFrame]:
    """(states, findings): a row per artifact with its state, reason and output; findings of verified ones."""
    records = scratch.save(extract.extract_records(artifacts, limits, method), "records")
    found = scratch.save(units.scan_units(records), "units")
    changed = scratch.save(rewritten_units(found, policy), "rewritten")
    outputs = units.assemble(units.rebuild_records(records, changed))
    # A pair of ids is one artifact: the records of copies at other places stay apart.
    reasons = records.groupBy(*IDS).agg(F.max("reason").alias("refused"), F.max("coverage").alias("coverage"))
    # The rewritten header is the name by which a selector would find the column again.
    left = with_residual(changed, policy).groupBy(*IDS).agg(F.bool_or("residual").alias("residual"))
    joined = artifacts.drop("content").join(reasons, IDS, "left").join(left, IDS, "left").join(outputs, IDS, "left")
    output = F.coalesce("output", F.lit(""))
    reason = F.coalesce("refused", evidence.reason_of((F.col("residual"), "VERIFICATION_FAILED"), (F.octet_length(output) > limits.max_bytes_per_artifact, "LIMIT_EXCEEDED")))
    states = joined.select(*artifacts.drop("content").columns, reason.alias("reason_code"), "coverage", output.alias("output"))
    states = states.withColumn("state", evidence.state_of(F.col("reason_code")))
    verified = F.col("state") == "VERIFIED"
    states = states.withColumns({
        "output_id": F.when(verified, digest(F.col("output"), method)), "output": F.when(verified, F.col("output")),
        "extractor_id": F.when(verified, F.concat(F.lit("lustrate."), F.lower("artifact_type"), F.lit(".v1"))),
        "coverage_hash": F.when(verified, digest(F.concat(F.lit("coverage.v1|"), "coverage"), method)),
    })
    states = scratch.save(states, "states")
    clean = states.where(verified).select(*IDS)
    findings = unit_findings(found, policy, key, method).join(clean, IDS, "left_semi")
    return states, findings


#: Bytes of files that are one transaction of a run, about.
BATCH_BYTES = 64 << 30
#: The codes for which a file may be quarantined.
REASONS = ("ENCRYPTED", "INTERNAL_ERROR", "LIMIT_EXCEEDED", "PARSE_ERROR", "UNKNOWN_COVERAGE", "UNSAFE_PATH", "UNSUPPORTED_FORMAT", "VERIFICATION_FAILED")


def batch_rows(artifacts: DataFrame, states: DataFrame, findings: DataFrame, quarantine_copy: bool) -> DataFrame:
    """All that one batch adds to a pack: files, and rows of every table of the ledger."""
    verified = states.where("state = 'VERIFIED'")
    name = inventory.output_path(F.col("source_locator_hash"), F.col("artifact_id"), F.col("artifact_type"))
    parts = [ledger.rows_of("files", verified.select(F.concat(F.lit("sanitized/"), name).alias("path"), F.col("output").cast("binary").alias("content")))]
    if quarantine_copy:
        bad = artifacts.join(states.where("state <> 'VERIFIED' AND reason_code <> 'LIMIT_EXCEEDED'").select(*IDS), IDS, "left_semi")
        raw = F.concat(F.lit("quarantine/raw/"), "source_locator_hash", F.lit("__"), "artifact_id", F.lit(".bin"))
        parts.append(ledger.rows_of("files", bad.select(raw.alias("path"), "content")))
    kind = F.coalesce("artifact_type", F.lit("FILE")).alias("artifact_type")
    parts.append(ledger.rows_of("artifacts", states.select(*IDS, "size_bytes", kind, "state", F.col("reason_code").alias("quarantine_reason_code"), "extractor_id", "coverage_hash", "output_id")))
    parts.append(ledger.rows_of("findings", findings))
    parts.append(ledger.rows_of("findings_summary", evidence.findings_summary(findings.withColumn("n", F.lit(1).cast("long")), tuple(IDS))))
    tokens = findings.groupBy(*IDS).agg(F.array_sort(F.collect_set("token")).alias("t"))
    parts.append(ledger.rows_of("proof_tokens", tokens.select(*IDS, F.posexplode("t").alias("token_index", "token"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows`` of a batch with totals and reasons counted in the pass that writes them."""
    seen, artifact = Observation(), F.col("kind") == "artifacts"
    state = lambda s: F.count_if(artifact & (F.col("state") == s))
    counts = [F.count_if(artifact).alias("artifacts_discovered"), state("VERIFIED").alias("artifacts_verified"), state("QUARANTINED").alias("artifacts_quarantined")]
    counts += [F.count_if(artifact & (F.col("quarantine_reason_code") == code)).alias(code) for code in REASONS]
    return rows.observe(seen, *counts, F.count_if(F.col("kind") == "findings").alias("findings")), seen


def evidence_lines(tables: dict[str, DataFrame]) -> DataFrame:
    tokens = tables["proof_tokens"].groupBy(*IDS).agg(F.sort_array(F.collect_list(F.struct("token_index", "token"))).alias("t"))
    return tables["artifacts"].join(tokens.select(*IDS, F.col("t.token").alias("proof_tokens")), IDS, "left")


def run(
    spark: SparkSession, input_dir: str, output_dir: str, policy_dir: str, limits: Limits | str | None = None, method: str = "sha2-256", secret: bytes | None = None,
    quarantine_copy: bool = False, batch_bytes: int = BATCH_BYTES,
) -> int:
    """Sanitises every file below ``input_dir`` into a pack; ``secret`` replaces the corpus in proof keys.

    Files go through in batches of neighbours in the order of their ids, each one transaction. A run that
    ended early is taken up again by the same call: files that a committed batch holds are neither
    extracted nor written again."""
    log = events.Events()
    try:
        policy = load_policy(policy_dir, method)
        limits = load_limits(limits) if isinstance(limits, str) else limits or Limits()
    except (PolicyError, ValueError) as e:
        print(f"usage: {e}")
        log("bad_usage", logging.ERROR, reason_code="USAGE")
        return USAGE
    pack = Path(output_dir)
    marker = pack / ".run"
    if pack.exists() and not marker.exists() and any(p.is_file() for p in pack.rglob("*")):  # the first one decides
        return USAGE  # a finished pack, or something else's folder
    scratch = Scratch(spark, "run")
    try:
        artifacts = scratch.save(inventory.read_corpus(spark, input_dir, method), "artifacts")
    except inventory.UnsafeInput as e:
        print(f"fatal: {e}")
        log("unsafe_input", logging.ERROR, reason_code="UNSAFE_PATH")
        return FATAL
    # The key is made of what only a holder of the files can compute; the manifest has none of it.
    root = hashlib.sha256(SECRET)
    marked = artifacts.select(*IDS, F.sha2(F.concat(F.lit(bytearray(SECRET)), F.coalesce("content", F.col("artifact_id").cast("binary"))), 256).alias("mark"))

    def ids():
        for r in marked.orderBy(*IDS).toLocalIterator():
            root.update(bytes.fromhex(r["mark"]))
            yield bytes.fromhex(r["artifact_id"])

    corpus_id = fold(ids(), method)[0].hex()
    run_id = hashed(__version__.encode() + bytes.fromhex(policy.policy_id) + bytes.fromhex(corpus_id), method)
    key = hashlib.sha256(b"lustrate.proof.key" + bytes.fromhex(run_id) + (secret if secret is not None else root.digest())).digest()
    log = events.Events(run_id=run_id, policy_id=policy.policy_id)
    common = {"tool_version": __version__, "run_id": run_id, "policy_id": policy.policy_id, "input_corpus_id": corpus_id, "tokenization_enabled": secret is not None, "quarantine_copy_enabled": quarantine_copy}
    commitment = hashed(b"lustrate.proof.commitment" + key, method)
    meta = {k: str(v).lower() if isinstance(v, bool) else v for k, v in common.items()} | {"schema_version": LEDGER, "digest": method, "proof_key_commitment": commitment, "proof_scope": "run"}
    resumed = marker.exists()
    if resumed:
        if marker.read_text() != run_id:
            log("resume_of_another_run", logging.ERROR, reason_code="USAGE")
            return FATAL  # another run's folder
        if (pack / "evidence" / "ledger" / "meta.json").exists() and ledger.read_meta(pack) != meta:
            log("resume_with_other_options", logging.ERROR, reason_code="USAGE")
            return USAGE
    else:
        sinks.write_whole(marker, run_id.encode())
    ledger.discard_staged(pack)
    ledger.write_meta(pack, meta)
    log("run_started", resumed=resumed)

    # What committed batches hold is done with, before anything is extracted.
    records = ledger.committed(pack)
    todo = evidence.unfinished(artifacts.select(*IDS, "size_bytes"), ledger.read(spark, pack, LEDGER)["artifacts"], IDS)
    cut = scratch.save(ordered.batches(todo, IDS, "size_bytes", batch_bytes, scratch), "batches")
    pending = [r["batch"] for r in cut.select("batch").distinct().orderBy("batch").collect()]
    log("files_listed", pending_batches=len(pending), committed_batches=len(records))
    if len(pending) > 1 or records:
        # Each batch reads its own folder, not the corpus.
        artifacts.join(cut.select(*IDS, "batch"), IDS).write.partitionBy("batch").parquet(scratch.path("by_batch"))
        part = lambda b: spark.read.schema(artifacts.schema).parquet(f"{scratch.path('by_batch')}/batch={b}")
    else:
        part = lambda b: artifacts
    first = max((r["batch"] for r in records), default=-1) + 1
    for number, b in enumerate(pending, first):
        own = Scratch(spark, f"batch{number}")
        states, findings = sanitize(part(b), policy, limits, method, own, key)
        findings = own.save(findings, "findings")
        rows, seen = observed(batch_rows(part(b), states, findings, quarantine_copy))
        ledger.commit_batch(rows, pack, number)
        log("batch_committed", batch=number, **{k: v for k, v in seen.get.items() if v})
        own.drop("records", "units", "rewritten", "states", "findings")

    tables = ledger.read(spark, pack, LEDGER)
    sinks.write_lines(evidence_lines(tables), IDS, pack / "evidence" / "artifacts.ndjson")
    bad = tables["artifacts"].where("state <> 'VERIFIED'").select(*IDS, F.col("quarantine_reason_code").alias("reason_code"))
    sinks.write_lines(bad, IDS, pack / "quarantine" / "index.ndjson")
    # Of a run in several parts, the earlier ones' counts are in the ledger only.
    totals = evidence.run_totals(tables["artifacts"]).first().asDict()
    reasons = {r["reason_code"]: r["count"] for r in evidence.reason_histogram(tables["artifacts"].withColumnRenamed("quarantine_reason_code", "reason_code")).orderBy("reason_code").collect()}
    sinks.write_json(pack / "evidence" / "run_manifest.json", common | {"totals": totals, "quarantine_reason_counts": reasons, "proof_scope": "run", "proof_key_commitment": commitment})
    # The manifest is the commit: a pack without it is not one.
    sinks.write_json(pack / "pack_manifest.json", common | {"pack_schema_version": PACK, "ledger_schema_version": LEDGER, "digest": method})
    os.remove(marker)
    ledger.discard_staged(pack)
    scratch.drop("artifacts", "batches", "by_batch", "ranges")
    log("run_completed", **totals)
    return QUARANTINED if totals["artifacts_quarantined"] else OK


def read_manifest(pack: Path) -> dict:
    """The manifest of a pack, checked as far as it can be without the pack's tables."""
    path = pack / "pack_manifest.json"
    if pack.is_symlink() or path.is_symlink():
        raise Fatal("the pack or its manifest is a link")
    try:
        manifest = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise Fatal(f"no readable manifest: {type(e).__name__}") from e
    texts = {"tool_version", "run_id", "policy_id", "input_corpus_id", "pack_schema_version", "ledger_schema_version", "digest"}
    flags = {"tokenization_enabled", "quarantine_copy_enabled"}
    if not isinstance(manifest, dict) or set(manifest) != texts | flags:
        raise Fatal("the manifest has other fields")
    if not all(isinstance(manifest[k], str) and manifest[k].strip() for k in texts) or not all(isinstance(manifest[k], bool) for k in flags):
        raise Fatal("a field of the manifest is empty or of another type")
    if manifest["pack_schema_version"] not in PACKS or manifest["ledger_schema_version"] not in ledger.READERS or manifest["digest"] not in ("sha2-256", "blake3"):
        raise Fatal("the manifest has other versions")
    return manifest


def verify(spark: SparkSession, pack_dir: str, policy_dir: str) -> int:
    """Reconciles a pack's evidence with its ledger and files, and scans its outputs again."""
    pack = Path(pack_dir)
    try:
        manifest = read_manifest(pack)
        method = manifest["digest"]
        policy = load_policy(policy_dir, method)
        if policy.policy_id != manifest["policy_id"]:
            return USAGE
        if manifest["ledger_schema_version"] != ledger.V1:
            meta = ledger.read_meta(pack)
            if any(meta.get(k) != manifest[k] for k in ("run_id", "policy_id", "input_corpus_id", "tool_version")) or meta.get("schema_version") != manifest["ledger_schema_version"]:
                raise Fatal("the ledger is of another run or version")
        folder = (pack / "evidence").resolve()
        names = ["artifact_id", *evidence.COMPARED]
        held = ledger.read(spark, pack, manifest["ledger_schema_version"])["artifacts"].select(*names)
        kinds = ", ".join(f"{n} {'long' if n == 'size_bytes' else 'string'}" for n in names)
        rows = spark.read.schema(kinds + ", extractor_id string, coverage_hash string, proof_tokens array<string>").option("mode", "FAILFAST").json(f"file://{folder}/artifacts.ndjson").select(*names)
        pair = F.concat_ws("/", *IDS)
        held, rows = held.withColumn("pair", pair), rows.withColumn("pair", pair)
        if evidence.duplicates(rows, "pair").head(1) or evidence.reconcile(held, rows, "pair").head(1):
            raise Fatal("evidence and ledger disagree")
        if rows.where("state = 'VERIFIED' AND output_id IS NULL").head(1):
            raise Fatal("a verified row without an output")
    except PolicyError:
        return USAGE
    except Exception as e:  # noqa: BLE001  whatever can't be read is a structural fault
        print(f"fatal: {e}")
        return FATAL

    root, scratch = (pack / "sanitized").resolve(), Scratch(spark, "verify")
    expected = rows.where("state = 'VERIFIED'").withColumn("path", inventory.output_path(F.col("source_locator_hash"), F.col("artifact_id"), F.col("artifact_type")))
    unsafe, there = root.is_symlink() or (pack / "sanitized").is_symlink(), listing.LISTED
    found = listing.files_below(spark, str(root), scratch) if root.is_dir() and not unsafe else spark.createDataFrame([], there)
    unsafe = unsafe or bool(found.where("kind <> 'file'").head(1))
    files = listing.read_files(found.where("kind = 'file'"), method)
    files = files.select(F.col("rel").alias("path"), F.col("size_bytes").alias("length"), F.col("artifact_id").alias("found_id"), F.coalesce("content", F.lit(b"")).alias("content"))
    both = expected.join(files, "path", "full_outer")
    content = both.select("path", F.col("artifact_id").isNotNull().alias("wanted"), "artifact_id", "source_locator_hash", "output_id", inventory.verification_type(F.col("artifact_type")).alias("artifact_type"), F.col("length").alias("size_bytes"), "found_id", "content")
    wrong = F.col("found_id") != F.col("output_id")
    checked = scratch.save(content.withColumn("stage", evidence.fail_stage(~F.col("wanted") | F.col("content").isNull(), wrong, F.lit(False))), "checked")
    records = scratch.save(extract.extract_records(checked.where("stage IS NULL")), "records")
    found = units.scan_units(records)
    residual = with_residual(found, policy, "text").where("residual").select(*IDS).distinct()
    failing = checked.where("stage IS NOT NULL").count() + residual.count() + records.where("reason IS NOT NULL").count()
    return QUARANTINED if failing or unsafe else OK


def policy_lint(policy_dir: str, method: str = "sha2-256") -> str:
    """The policy's id; raises ``PolicyError`` for a bad one."""
    return load_policy(policy_dir, method).policy_id


def export_sqlite(spark: SparkSession, pack_dir: str, path: str) -> None:
    """The ledger of a pack as one SQLite file, streamed through the driver."""
    pack = Path(pack_dir)
    held = ledger.read(spark, pack, read_manifest(pack)["ledger_schema_version"])
    with sqlite3.connect(path) as db:
        for name, df in held.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(df.columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in df.toLocalIterator()))
        db.execute("CREATE TABLE meta (key, value)")
        db.executemany("INSERT INTO meta VALUES (?, ?)", sorted(ledger.read_meta(pack).items()))
