"""The pipeline's stages: what goes, what stays, and that each keeps the columns of documents."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_filter_and_keep_columns(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456", None, None, 7), (10**6 + 1, None, None, None, 0)], given.schema)
    docs, kept = given.unionByName(junk), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == given.columns, name
        out.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        docs = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    first, exact, near, clean, last = kept
    assert not first & {10**6, 10**6 + 1} and first >= exact >= near >= clean == last
    # Exact duplicates leave the largest id of each text, whatever its case.
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = given.where(F.col("doc_id").isin(*first)).groupBy(low).agg(F.max("doc_id").alias("keep"))
    assert exact == {r["keep"] for r in rows.collect()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.where("size(ids) <> n_tokens").count() == 0 and out.count() > 100


def test_columns_that_clash_with_a_stage_stay_as_they_are(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    clashing = given.withColumns({"score": F.lit(-7.5), "lang_pred": F.lit("x"), "_id": F.lit(3), "kept": F.lit(False), "held_out": F.lit(1)})
    docs = clashing.unionByName(clashing.where("doc_id < 5")).unionByName(clashing.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert {(r["score"], r["lang_pred"], r["_id"], r["kept"], r["held_out"]) for r in rows} <= {(-7.5, "x", 3, False, 1)} and rows
        assert stage(spark, clashing.where("false"), sf_dir).count() == 0
