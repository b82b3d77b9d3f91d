"""Evidence: states, summaries, histograms, token sets and reconciliation, as aggregations and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustrate.functions.digests import digest

#: What the ledger and the evidence must agree on.
COMPARED = ("source_locator_hash", "size_bytes", "artifact_type", "state", "quarantine_reason_code", "output_id")


def reason_of(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds, in the order given; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(code)) for failed, code in checks])


def state_of(reason: Column) -> Column:
    return F.when(reason.isNull(), F.lit("VERIFIED")).otherwise(F.lit("QUARANTINED"))


def coverage_hash(surfaces: dict[str, Column], method: str = "sha2-256") -> Column:
    pieces = [F.concat(F.lit(f"{name}="), value) for name, value in surfaces.items()]
    return digest(F.concat_ws("|", F.lit("coverage.v1"), *pieces), method)


def findings_summary(findings: DataFrame, keys: tuple[str, ...] = ("artifact_id",)) -> DataFrame:
    """Counts by artifact and class of ``findings`` (keys, class_id, severity, action, n); no zero rows."""
    sums = findings.groupBy(*keys, "class_id", "severity", "action").agg(F.sum("n").alias("count"))
    return sums.where("count > 0")


def run_totals(states: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s)
    return states.agg(F.count("*").alias("artifacts_discovered"), count("VERIFIED").alias("artifacts_verified"), count("QUARANTINED").alias("artifacts_quarantined"))


def reason_histogram(states: DataFrame) -> DataFrame:
    return states.where("state = 'QUARANTINED'").groupBy("reason_code").agg(F.count("*").alias("count"))


def token_sets(tokens: DataFrame, key: str) -> DataFrame:
    """Distinct tokens of each artifact, sorted."""
    return tokens.groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("proof_tokens"))


def first_wins(artifacts: DataFrame, key: str = "artifact_id", order: str = "source_locator_hash") -> DataFrame:
    """One row of each key, the first by ``order``: a keyed upsert that freezes what is terminal.

    An aggregate and not a window, so a key with very many rows is combined before the shuffle.
    """
    others = [c for c in artifacts.columns if c != key]
    least = artifacts.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("r"))
    return least.select(key, "r.*")


def reconcile(ledger: DataFrame, evidence: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Rows on which the two sides disagree: missing, extra, or the fields that differ."""
    left = ledger.select(key, F.struct(*COMPARED).alias("l"))
    right = evidence.select(key, F.struct(*COMPARED).alias("e"))
    both = left.join(right, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")), F.lit(c)) for c in COMPARED]))
    kind = F.when(F.col("e").isNull(), F.lit("missing")).when(F.col("l").isNull(), F.lit("extra")).when(F.size(differs) > 0, F.lit("different"))
    return both.select(key, kind.alias("problem"), F.when(kind == "different", F.array_join(differs, ",")).alias("fields")).where("problem IS NOT NULL")


def duplicates(rows: DataFrame, key: str = "artifact_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("count")).where("count > 1")


def unfinished(artifacts: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts without a terminal row in the ledger: what a resumed run has left to do."""
    done = ledger.where(F.col("state").isin("VERIFIED", "QUARANTINED")).select(*keys)
    return artifacts.join(done, keys, "left_anti")


def fail_stage(unsafe: Column, wrong_hash: Column, residual: Column) -> Column:
    """The first of the checks that fails; the later ones are not looked at."""
    return F.when(unsafe, F.lit("safety")).when(wrong_hash, F.lit("hash")).when(residual, F.lit("residual"))


def in_order(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Lines of each key joined in order."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("l"))
    return lists.select(key, F.array_join(F.col(f"l.{value}"), "\n").alias(out))
