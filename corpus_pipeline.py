"""From raw documents to training tokens: language ID, exact and near deduplication, decontamination,
BPE encoding. Each stage works on what its predecessor kept; all but the last keep the columns of
``documents``.

Results for odd input: documents of no language (null, empty, without letters) go in the first stage;
a null doc_id is an id like others; rows that share an id are one document, so a verdict on one is a
verdict on all; extra columns are carried to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustrate.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from lustrate.scratch import Scratch, small

#: Posterior of its best language that a document needs.
SURE = 0.5
#: Bytes of a stage's verdicts that may be broadcast; more are joined by a shuffle.
VERDICT_BYTES = 16 << 20


def pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids`` (left_semi) or not (left_anti)."""
    held = Scratch(docs.sparkSession, "verdict").save(ids.select(F.col("doc_id").alias("_id")).distinct(), "ids")
    # A row travels as one value, so that its columns clash with nothing.
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    return whole.join(small(held, 16, VERDICT_BYTES), F.col("_row.doc_id").eqNullSafe(F.col("_id")), how).select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    vocab = language_id.default_vocabulary()
    # The verdict travels beside the row, which may have columns of its names.
    whole = docs.select("text", F.struct(*docs.columns).alias("_row"))
    judged = language_id.predict(whole, vocab, *language_id.learn(docs, vocab), keep_text=True)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest doc_id of each group of equal texts."""
    return pick(docs, exact_dedup.exact_dedup(docs).where("kept"), "left_semi")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by near copies: five words, similarity 0.8."""
    return pick(docs, near_dedup.near_groups(docs, width=5, num=80, den=100).where("kept"), "left_semi")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, copied or paraphrased."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return pick(docs, decontaminate.find_leaks(docs, benchmark), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("bpe", tokens)]
#: Language ID, near deduplication, decontamination and BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and reread."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
