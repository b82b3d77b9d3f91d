"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: any executor can read it again
after another was lost. Nothing here touches a machine-local temporary folder on a cluster; only
when the setting is missing (local runs, tests) a folder is made up and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one is set where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    own = tempfile.mkdtemp(prefix="lustrate-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Scratch:
    """Tables saved for one operator call; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def write_bytes(self, label: str, data: bytes) -> str:
        """One small file of the driver's, for ``addFile``; returns its path."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(label))
        out = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(path)
        try:
            out.write(data)
        finally:
            out.close()
        return self.path(label)

    def drop(self, *labels: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.path(label))
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer tasks than the session has cores, dealt over all cores; others as they are.

    Small files and single row groups would leave cores idle under heavy expressions; large tables
    have tasks enough and are never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt by ``key`` over a task for each ``rows`` rows, and one for each core at least: for small rows
    that make much work, where files of a few pieces (or exchanges that are coalesced by their bytes) would
    leave most cores idle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def small(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """``df`` (a saved table) with a broadcast hint if its counted rows fit ``limit`` bytes.

    Beyond the limit the frame comes back plain, so the join shuffles and AQE splits its hot keys.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
