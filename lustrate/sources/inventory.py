"""Listing a corpus: one row per file with its identities and its type by extension."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustrate.functions.digests import digest
from lustrate.scratch import Scratch
from lustrate.sources import listing

# Types by extension, the extension of the sanitised output, and the types that
# containers are re-verified as.
TYPES = {"txt": "TEXT", "csv": "CSV", "tsv": "TSV", "json": "JSON", "ndjson": "NDJSON", "zip": "ZIP", "tar": "TAR", "eml": "EML", "mbox": "MBOX", "docx": "DOCX", "pptx": "PPTX", "xlsx": "XLSX"}
CONTAINERS = ("ZIP", "TAR", "EML", "MBOX", "DOCX", "PPTX", "XLSX")
OUTPUT = {"TEXT": "txt", "CSV": "csv", "TSV": "tsv", "JSON": "json", "NDJSON": "ndjson"} | dict.fromkeys(CONTAINERS, "ndjson")


class UnsafeInput(ValueError):
    pass


def _lookup(table: dict[str, str], key: Column, default: str | None) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def artifact_type(path: Column) -> Column:
    """One of the twelve types by the extension of the last part of ``path``, or null."""
    name = F.element_at(F.split(path, "/"), -1)
    return _lookup(TYPES, F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)), None)


def output_extension(kind: Column) -> Column:
    return _lookup(OUTPUT, F.coalesce(kind, F.lit("")), "bin")


def verification_type(kind: Column) -> Column:
    return F.when(kind.isin(*CONTAINERS), F.lit("NDJSON")).otherwise(kind)


def is_risky(kind: Column) -> Column:
    return F.coalesce(kind.isin(*CONTAINERS), F.lit(False))


def output_path(locator_hash: Column, artifact_id: Column, kind: Column) -> Column:
    return F.concat(locator_hash, F.lit("__"), artifact_id, F.lit("."), output_extension(kind))


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Files without bytes, which Spark's file scans leave out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing, found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(path, True), []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            found.append(status.getPath().toString())
    return found


def relative(path: Column, root: str) -> Column:
    """The part of ``path`` below the folder ``root``: equal names in two folders stay apart."""
    if "://" not in root:
        root = os.path.abspath(root.removeprefix("file:"))
    return F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), "^" + _quoted(root) + "/*", "")


def read_corpus(spark: SparkSession, root: str, method: str = "sha2-256") -> DataFrame:
    """artifact_id, source_locator_hash, rel, size_bytes, artifact_type, content of every file.

    Mounted folders are listed and read by tasks; symbolic links and special files are fatal. Other stores
    are listed by Spark, which leaves out empty files and can't hold those of more than 2 GB in a row."""
    if "://" in root and not root.startswith("file:"):
        return read_store(spark, root, method)
    scratch = Scratch(spark, "listing")
    found = listing.files_below(spark, root.removeprefix("file://"), scratch)
    if odd := found.where("kind <> 'file'").head(1):
        raise UnsafeInput(f"a {odd[0]['kind']} is not a plain file or folder")
    files = listing.read_files(found, method)
    return files.select("artifact_id", digest(F.col("rel"), method).alias("source_locator_hash"), "rel", "size_bytes", artifact_type(F.col("rel")).alias("artifact_type"), "content")


def read_store(spark: SparkSession, root: str, method: str) -> DataFrame:
    """``read_corpus`` by Spark's own reader of files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Spark can't hold a larger file in a row; its id comes of its place and size, and it has no content.
    files, large = found.where(F.col("length") <= listing.READABLE), found.where(F.col("length") > listing.READABLE).select("path", "length")
    rel = relative(F.col("path"), root)
    large = large.select(
        digest(F.concat_ws("\n", F.lit("unread"), rel, F.col("length").cast("string")), method).alias("artifact_id"), digest(rel, method).alias("source_locator_hash"), rel.alias("rel"),
        F.col("length").alias("size_bytes"), artifact_type(rel).alias("artifact_type"), F.lit(None).cast("binary").alias("content"),
    )
    empty = spark.createDataFrame([(p, 0, bytearray()) for p in empty_files(spark, root)], "path string, length long, content binary")
    named = files.select("path", "length", "content").unionByName(empty).withColumn("rel", rel)
    return named.select(
        digest(F.col("content"), method).alias("artifact_id"), digest(F.col("rel"), method).alias("source_locator_hash"), "rel",
        F.col("length").alias("size_bytes"), artifact_type(F.col("rel")).alias("artifact_type"), "content",
    ).unionByName(large)


def _quoted(root: str) -> str:
    import re

    return re.escape(re.sub("^[a-z]+:/*", "/", root).rstrip("/"))
