"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Every row falls into one of ``B`` blocks by a hash of its narrow columns. How many rows of each
block go to each piece of each shard is drawn first, exactly, on the driver: that matrix of at most
``MAX_BLOCKS x shards x MAX_PIECES`` numbers has the law that a uniform permutation of all rows
gives. Then each block is permuted (random order, cut by its row of the matrix), the rows move to
their pieces, and each piece is permuted again, which gives the slot. All row work is DataFrame
operations; only per-block counts reach the driver.

Results for odd input: an empty table gives no rows; null ids and texts are ordinary values; rows
equal in every column are interchangeable, so repeated rows each get a slot of their own.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts at the least before more blocks or pieces are made.
BLOCK_ROWS = 65_536
MIN_BLOCKS, MAX_BLOCKS, MAX_PIECES = 64, 1024, 42


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, also past numpy's limit of 1e9."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mean = draws * good / total
    sd = math.sqrt(max(1.0, mean * (bad / total) * (total - draws) / max(1, total - 1)))
    start, stop = max(low, int(mean - 40 * sd)), min(high, int(mean + 40 * sd))
    k = np.arange(start, stop, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return start + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def draw_matrix(rng: np.random.Generator, blocks: list[int], pieces: list[int]) -> list[list[int]]:
    """Counts by block and piece with the given sums, as a uniform permutation would give them."""
    left, out = list(pieces), []
    for n in blocks:
        row, rest = [], sum(left)
        for room in left:
            take = hypergeometric(rng, room, rest - room, n)
            row.append(take)
            rest, n = rest - room, n - take
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shard_rows(df: DataFrame, shards: int, key: list[str], seed: int = 20_240_501, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` plus ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``key`` names the columns that tell rows apart; they alone feed the random order, so a lost
    task that runs again makes the same choice. Shards differ by one row at most.
    """
    spark = df.sparkSession
    # Columns with these names in df itself, clashing or not, are replaced.
    df = df.drop("shard", "slot", "_block", "_at", "_piece")
    total = df.count()
    blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, math.ceil(total / block_rows)))
    chaos = lambda salt: F.xxhash64(F.lit(seed + salt), *[F.col(c) for c in key])
    placed = df.withColumn("_block", F.pmod(chaos(0), F.lit(blocks)).cast("int"))
    held = {r["_block"]: r["n"] for r in placed.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    counts = [held.get(b, 0) for b in range(blocks)]
    total = sum(counts)

    sizes = even(total, shards)
    per = min(MAX_PIECES, max(1, math.ceil(sizes[0] / block_rows)))
    pieces = [n for size in sizes for n in even(size, per)]
    matrix = np.array(draw_matrix(np.random.default_rng(seed), counts, pieces), dtype=np.int64).reshape(blocks, shards, per)
    ends = np.cumsum(matrix.reshape(blocks, -1), axis=1).reshape(blocks, shards, per)
    starts = [[sum(even(size, per)[:j]) for j in range(per)] for size in sizes]

    table = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    shard_ends, piece_ends = table(ends[:, :, -1].tolist(), "array<array<bigint>>"), table(ends.tolist(), "array<array<array<bigint>>>")
    bounds = spark.range(1).select(shard_ends.alias("_shard_ends"), piece_ends.alias("_piece_ends"), table(starts, "array<array<bigint>>").alias("_starts"))
    matrix_rows = bounds.select(F.posexplode("_shard_ends").alias("_block", "_shard_ends"), "_piece_ends", "_starts")
    matrix_rows = matrix_rows.select("_block", "_shard_ends", F.element_at("_piece_ends", F.col("_block") + 1).alias("_piece_ends"), "_starts")

    local = Window.partitionBy("_block").orderBy(chaos(1), *key)
    passed = lambda column, at: F.size(F.filter(column, lambda end: end <= at))
    permuted = placed.withColumn("_at", F.row_number().over(local) - 1)
    # The matrix has a bounded number of rows (MAX_BLOCKS), so broadcasting it is safe at any size.
    dealt = (
        permuted.join(F.broadcast(matrix_rows), "_block")
        .withColumn("shard", passed(F.col("_shard_ends"), F.col("_at")))
        .withColumn("_piece", passed(F.element_at("_piece_ends", F.col("shard") + 1), F.col("_at")))
        .withColumn("_start", F.element_at(F.element_at("_starts", F.col("shard") + 1), F.col("_piece") + 1))
        .drop("_shard_ends", "_piece_ends", "_starts", "_block", "_at")
    )
    again = Window.partitionBy("shard", "_piece").orderBy(chaos(2), *key)
    return dealt.withColumn("slot", F.col("_start") + F.row_number().over(again) - 1).drop("_piece", "_start")


def op1_hypergeometric_shards(spark, sf_dir):
    """All documents into 24 shards by the law ``rows``: shard sizes differ by one row at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shard_rows(rows, 24, ["doc_id", "size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
