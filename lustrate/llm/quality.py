"""Document quality by hierarchical empirical Bayes over host, path and document.

A logistic model on surface features (fitted on a bounded, hash-chosen sample of labelled rows) gives
each document its evidence. Grouped aggregation sums labels, and the model's probabilities where
there is no label, by path and by host. A beta prior fitted by moments to the hosts of the whole
table shrinks each host to the global mean; a second one, fitted to the paths around their hosts,
shrinks each path to its host. A document's posterior log-odds are its own evidence plus what its
path's posterior says beyond the global mean.

Host and path come from ``source``: up to the first ``/`` and the rest; where there is no ``/`` the
language stands for the path, as sites keep their languages apart.

Results for odd input: a null or empty text has the features of an empty one; null sources and
languages form groups of their own (the empty name); without labels of both kinds every document
has the prior 0.5 as evidence; repeated labels of a document are averaged; repeated rows are scored
alike; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lustrate.llm.hashing import word_hashes
from lustrate.llm.sampling import sampled
from lustrate.scratch import Scratch, small

#: Labelled rows in the fit at most; a document is kept from this posterior on.
SAMPLE, KEEP = 20_000, 0.5
#: Bytes of the table of paths that may be broadcast; a larger one is shuffled.
PATHS_BYTES = 16 << 20
FEATURES = ("size", "letters", "upper", "digits", "spaces", "lines", "stops", "symbols", "bars", "distinct", "word")

CLASSES = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:!?'\"()-", b"#$%&*@^~=+<>/\\[]{}_`", b"|"), start=1):
    CLASSES[list(_bytes)] = _k


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` for each text: log size, shares of kinds of bytes, share of distinct
    words, mean word length."""
    words, starts = word_hashes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        n, count = len(text), int(starts[i + 1] - starts[i])
        kinds = np.bincount(CLASSES[np.frombuffer(text, dtype=np.uint8)], minlength=9) / max(1, n)
        distinct = len(np.unique(words[starts[i] : starts[i + 1]])) / max(1, count) ** 0.9
        out[i] = [np.log1p(n), kinds[0] + kinds[1] + kinds[2], *kinds[2:9], distinct, np.log1p(n / max(1, count))]
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``x`` (array of features) in place of ``text``."""
    others = [c for c in docs.columns if c != "text"]
    schema = StructType([*(docs.schema[c] for c in others), StructField("x", ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            x = text_features([(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(list(x), pa.list_(pa.float64()))], [*others, "x"])

    return docs.mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[float, np.ndarray]:
    """Intercept and weights for raw features, by Newton steps on standardised ones."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, np.zeros(len(FEATURES))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - penalty @ w
        w = w + np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, gradient)
    return float(w[0] - (w[1:] * mean / scale).sum()), w[1:] / scale


def logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean) -> float:
    """Beta prior's weight, in documents, from groups with ``good`` of ``n`` around ``mean`` (moments)."""
    rate = F.col("good") / F.col("n")
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread"), F.sum(mean * (1 - mean)).alias("noise"),
        F.sum("n").alias("n"), F.sum(F.col("n") * mean * (1 - mean)).alias("base"), F.count("*").alias("groups"),
    ).first()
    if not row["groups"] or not row["base"]:
        return 10.0
    # Within-group noise adds about one base variance a group; what is left is spread between groups.
    between = max(0.0, (row["spread"] - row["noise"]) / row["n"])
    share = between / (row["base"] / row["n"])
    return min(1e6, max(1.0, 1 / share - 1)) if share > 0 else 1e6


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score and kept for every row of ``docs``
    (doc_id, text, source, lang), given ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    source = F.coalesce("source", F.lit(""))
    slash = F.instr(source, "/")
    site = docs.select(
        "doc_id", "text", F.when(slash > 0, F.substring_index(source, "/", 1)).otherwise(source).alias("host"),
        F.when(slash > 0, F.expr("substring(coalesce(source, ''), instr(source, '/') + 1)")).otherwise(F.coalesce("lang", F.lit(""))).alias("path"),
    )
    rows = scratch.save(with_features(site), "features")
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    rows = rows.join(marks.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")

    labelled = rows.where("quality IS NOT NULL")
    share = min(1.0, sample / max(1, labelled.count()))
    chosen = labelled.where(sampled("doc_id", share)).select("x", F.round("quality").alias("y")).toPandas()
    x = np.stack(chosen["x"]) if len(chosen) else np.zeros((0, len(FEATURES)))
    base, weights = logistic(x, chosen["y"].to_numpy(dtype=float))

    line = F.lit(base) + sum((F.lit(float(w)) * F.col("x")[i] for i, w in enumerate(weights)), F.lit(0.0))
    rows = rows.select("doc_id", "host", "path", "quality", line.alias("line"))
    rows = rows.withColumn("evidence", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("line"))))))
    rows = scratch.save(rows, "evidence")
    scratch.drop("features")

    good = F.coalesce("quality", "evidence")
    paths = scratch.save(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good")), "paths")
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    whole = hosts.agg(F.sum("good"), F.sum("n")).first()
    prior = (whole[0] + 0.5) / (whole[1] + 1) if whole[1] else 0.5
    weight = strength(hosts, F.lit(prior))
    of_host = lambda own, n: (F.col("host_good") - own + weight * prior) / (F.col("host_n") - n + weight)
    paths = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host")
    path_weight = strength(paths.withColumn("mean", of_host(F.lit(0.0), 0)), F.col("mean"))
    paths = small(scratch.save(paths, "posteriors"), 256, PATHS_BYTES)

    def of_path(own, n: int, host):
        return (F.col("good") - own + path_weight * host) / (F.col("n") - n + path_weight)

    none, own = F.lit(0.0), F.coalesce("quality", "evidence")
    out = rows.join(paths, ["host", "path"]).withColumn("host_posterior", of_host(none, 0)).withColumn("path_posterior", of_path(none, 0, F.col("host_posterior")))
    # A document's line holds its own value already, so its score takes what the other documents of its
    # host and path say.
    out = out.withColumn("others", of_path(own, 1, of_host(own, 1)))
    odds = F.col("line") + logit(F.col("others")) - logit(F.lit(float(prior)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= keep).alias("kept"))


def op3_hierarchical_quality(spark, sf_dir):
    """Posterior quality of every document from its text, its source and its source's languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
