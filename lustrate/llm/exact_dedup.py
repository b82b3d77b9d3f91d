"""Exact deduplication by distributed MSD radix partitioning.

Each round splits every open group by the next bytes of its texts (a radix digit of growing width).
A group closes when it has one row or when its texts have ended; equal closed texts have gone
through the same digits to their end, so no digest is compared. Groups are counted by partial
aggregation and rows find their group by an equi-join on (group, digit), so a group of copies that
holds a third of the table is split over tasks by AQE. Rows still open are written to the shared
folder, without the bytes already used, before the next round. Their number of rounds follows the
longest text with an equal prefix: widths grow sixteenfold.

Results for odd input: a null text counts as empty; null ids lose to any other id; a group that has
null ids only keeps null, and all its rows; rows with the same id and text all carry that id's
verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustrate.scratch import Scratch

#: Bytes of the first digit, and how many times wider each next one is.
FIRST_BYTES, GROWTH = 64, 16


def ascii_lower(text):
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def radix_groups(rows: DataFrame, scratch: Scratch, first: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """``rows`` (doc_id, bytes, and others) with ``keep_id`` and ``group_size`` in place of ``bytes``."""
    done, width, level = None, first, 0
    open_rows = rows.withColumn("_group", F.lit(0).cast("long"))
    while True:
        digit = F.substring("bytes", 1, width)
        digits = open_rows.groupBy("_group", digit.alias("_digit")).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
        # A digit that is not full holds the end of its texts; a single row needs no further look.
        digits = digits.withColumn("_open", F.octet_length("_digit") == width).withColumn("_next", F.monotonically_increasing_id())
        digits = scratch.save(digits, f"digits{level}")
        joined = open_rows.withColumn("_digit", digit).join(digits.hint("merge"), ["_group", "_digit"], "left").drop("_group", "_digit")
        split = joined.withColumns({
            "_open": F.coalesce("_open", F.lit(False)), "group_size": F.coalesce("group_size", F.lit(1)),
            "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
        })
        split = split.withColumn("bytes", F.when(F.col("_open"), F.expr(f"substring(bytes, {width + 1})")))
        split = scratch.save(split.withColumnRenamed("_next", "_group"), f"rows{level}")
        scratch.drop(f"digits{level}")
        closed = split.where("NOT _open").drop("bytes", "_open", "_group")
        done = closed if done is None else done.unionByName(closed)
        open_rows = split.where("_open").drop("_open", "group_size", "keep_id")
        if not open_rows.head(1):
            return done
        width, level = width * growth, level + 1


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 of the lower-cased text."""
    scratch = Scratch(docs.sparkSession, "exact")
    lowered = docs.select("doc_id", ascii_lower(F.col(text)).cast("binary").alias("bytes"))
    rows = lowered.select("doc_id", "bytes", F.sha2("bytes", 256).alias("text_sha256"))
    out = radix_groups(rows, scratch)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op10_radix_dedup(spark, sf_dir):
    """Exact groups of all documents; the largest doc_id of each stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM low GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM low JOIN groups USING (t)
"""
