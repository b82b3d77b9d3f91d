"""Files that keep arriving: the same detection and rewriting as a streaming query.

Structured Streaming's checkpoint takes the place of a resume marker: each batch of new files is
judged once and appended, exactly once per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lustrate.functions.digests import digest
from lustrate.plans.engine import sanitize
from lustrate.plans.policy import Limits, Policy
from lustrate.scratch import Scratch
from lustrate.sources import inventory


def watch(spark: SparkSession, folder: str, policy: Policy, out: str, checkpoint: str, limits: Limits = Limits(), method: str = "sha2-256") -> StreamingQuery:
    """Judges the files that are there and those that come; states go to Parquet below ``out``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rel = inventory.relative(F.col("path"), folder)
    artifacts = files.select(
        digest(F.col("content"), method).alias("artifact_id"), digest(rel, method).alias("source_locator_hash"), rel.alias("rel"),
        F.col("length").alias("size_bytes"), inventory.artifact_type(rel).alias("artifact_type"), "content",
    )

    def judge(batch: DataFrame, number: int) -> None:
        scratch = Scratch(batch.sparkSession, f"batch{number}")
        states, _ = sanitize(scratch.save(batch, "artifacts"), policy, limits, method, scratch)
        # A batch that runs again overwrites its own folder.
        states.write.mode("overwrite").parquet(f"{out}/batch={number}")
        scratch.drop("artifacts", "records", "units", "rewritten", "states")

    return artifacts.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
