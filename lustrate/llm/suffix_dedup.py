"""Repeated passages removed byte by byte, by sorting suffixes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of a
smaller id, or earlier in the same one. Strings never cross documents and are judged on the input.

1. Rows with equal texts are one text, of their smallest id; the others go as a whole (or, when they
   are shorter than ``LENGTH``, stay as they are).
2. Every string is put down to its anchor, the smallest hash among its ``GRAM``-byte substrings.
   Equal strings have equal anchors, so only strings whose anchor occurs twice can be repeated; a text
   has about one anchor for 35 bytes. Strings with one anchor make a segment of at most
   ``2 LENGTH - GRAM`` bytes; equal segments are sorted once, as the earliest of them.
3. Segments are dealt to shards by anchor. The strings of an anchor with more than ``HOT`` bytes are
   dealt by 128-bit hashes of their bytes instead, and compared with the earliest of their hash, so no
   anchor has to fit one task. Each other shard is sorted by external induced sorting, which
   carries common-prefix lengths; neighbours that share ``LENGTH`` bytes are equal strings, and all but
   the earliest of them are repeats.
4. Repeats come together by document as ranges of bytes, and each text is cut.

Results for odd input: a null text is empty; rows with equal id and text count as one; ids that are
null come after all others; among different texts with one id the order is that of a hash of the
text; very long texts are hashed piece by piece; an empty table gives no rows; other columns are
passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustrate.llm.hashing import NUMBERS, mix
from lustrate.llm.induced_sort import sorted_suffixes
from lustrate.scratch import Scratch, small

LENGTH, GRAM = 100, 32
#: Bytes hashed together, and bytes of segments sorted together unless one anchor has more.
PIECE, SHARD = 1 << 19, 6 << 20
#: Bytes of distinct segments from which an anchor's strings are dealt by themselves.
HOT = SHARD
#: Bytes of the table of repeats by document that may be broadcast; a larger one is shuffled.
MARKS_BYTES = 32 << 20
END = 0xFF  # no byte of UTF-8
STEP = np.uint64(0xD6E8FEB86659FD93)
U64 = np.uint64


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte substrings, by doubling."""
    h, width, factor = NUMBERS_EXACT[raw], 1, STEP
    while width < GRAM:
        h = h[:-width] * factor + h[width:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        width *= 2
    return mix(h)


#: Upper and lower case differ here, unlike in hashes of words.
NUMBERS_EXACT = mix(NUMBERS ^ (np.arange(256, dtype=np.uint64) << U64(7)))


def segments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string and number of strings of the segments of a piece of one text."""
    count = len(raw) - LENGTH + 1
    if count <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = gram_hashes(raw)
    # The place in the low bits breaks ties to the left and tells anchors of equal hash apart.
    low = U64((1 << 20) - 1)
    least, span, width = (hashes & ~low) | np.arange(len(hashes), dtype=U64), LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    starts = np.flatnonzero(np.diff(least, prepend=~least[0]))
    return hashes[(least[starts] & low).astype(np.int64)], starts, np.diff(np.append(starts, count))


def text_segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a whole text, piece by piece; pieces overlap by all but one byte of a string."""
    raw = np.frombuffer(text, dtype=np.uint8)
    parts = []
    for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
        anchor, start, count = segments(raw[at : at + PIECE + LENGTH - 1])
        parts.append((anchor, start + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(texts: DataFrame) -> DataFrame:
    """(anchor, doc, tag, start, count) of all segments of ``texts`` (doc, tag, bytes)."""

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 2000):
                some = batch.iloc[low : low + 2000]
                found = [text_segments(t) for t in some["bytes"]]
                sizes = [len(x[0]) for x in found]
                yield pd.DataFrame({
                    "anchor": signed(np.concatenate([x[0] for x in found])), "doc": np.repeat(some["doc"].to_numpy(), sizes), "tag": np.repeat(some["tag"].to_numpy(), sizes),
                    "start": np.concatenate([x[1] for x in found]).astype(np.int32), "count": np.concatenate([x[2] for x in found]).astype(np.int32),
                })

    return texts.mapInPandas(run, "anchor long, doc long, tag long, start int, count int")


def cut_segments(marked: DataFrame, with_bytes: bool) -> DataFrame:
    """Segments named in ``marked`` (doc, tag, bytes, marks: arrays of anchor, start, count), with a
    128-bit hash of their bytes, or the bytes."""
    schema = "anchor long, doc long, tag long, start int, count int, " + ("segment binary" if with_bytes else "same binary")

    def run(batches):
        for batch in batches:
            rows = []
            for doc, tag, text, anchor, start, count in zip(*(batch[c] for c in ("doc", "tag", "bytes", "anchors", "starts", "counts"))):
                for a, s, n in zip(anchor, start, count):
                    cut = text[s : s + n + LENGTH - 1]
                    rows.append((a, doc, tag, s, n, cut if with_bytes else hashlib.blake2b(cut, digest_size=16).digest()))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return marked.select("doc", "tag", "bytes", "anchors", "starts", "counts").mapInPandas(run, schema)


def marks(rows: DataFrame) -> DataFrame:
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("anchor", "start", "count")]
    return rows.groupBy("doc", "tag").agg(*lists)


def repeats_in(rows: list[tuple]) -> pd.DataFrame:
    """Ranges of strings that also start earlier, among segments (doc, tag, start, count, bytes)."""
    doc, tag, start, _, cuts = zip(*rows)
    sizes = np.array([len(c) + 1 for c in cuts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(c + bytes([END]) for c in cuts), dtype=np.uint8)
    doc, tag, start = (np.array(x, dtype=np.int64) for x in (doc, tag, start))
    # Segments in the order of documents, and by their start within one: so are their strings numbered.
    # Rows with equal id and text bring the same segment twice, with the same numbers.
    order = np.lexsort((start, tag, doc))
    again = np.zeros(len(cuts), dtype=bool)
    again[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (doc, tag, start)])
    strings = sizes[order] - LENGTH
    firsts = np.cumsum(np.where(again, 0, strings)) - strings
    numbers = np.empty(len(cuts), dtype=np.int64)
    numbers[order] = firsts
    # Narrow types, and nothing kept that can be made again: the sort needs the memory.
    kind = np.int32 if len(text) < 2**31 else np.int64
    place = np.repeat((numbers - begins).astype(kind), sizes) + np.arange(len(text), dtype=kind)
    string = np.ones(len(text), dtype=bool)
    for k in range(LENGTH):
        string[begins + sizes - 1 - k] = False
    positions, prefixes = zip(*sorted_suffixes(text, LENGTH))
    positions, prefixes = np.concatenate(positions), np.concatenate(prefixes)
    group = np.cumsum(prefixes < LENGTH, dtype=kind)
    del prefixes
    kept = string[positions]
    positions, group = positions[kept], group[kept]
    del kept, string
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.repeat(np.minimum.reduceat(place[positions], firsts), np.diff(np.append(firsts, len(group)))) if len(group) else np.zeros(0)
    repeat = np.zeros(len(text) + 1, dtype=np.int8)
    repeat[positions[place[positions] > least]] = 1
    edges = np.flatnonzero(np.diff(repeat, prepend=0))
    low, high = edges[::2], edges[1::2]
    of = np.searchsorted(begins, low, side="right") - 1
    first = start[of] + low - begins[of]
    return pd.DataFrame({"doc": doc[of], "tag": tag[of], "low": first, "high": first + (high - low) - 1 + LENGTH})


def sort_shards(cuts: DataFrame) -> DataFrame:
    """(doc, tag, low, high): bytes covered by repeats, of segments partitioned and sorted by anchor."""

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch[c] for c in ("doc", "tag", "start", "count", "segment", "anchor"))):
                if size > SHARD and row[5] != last:
                    yield repeats_in(rows)
                    rows, size = [], 0
                rows.append(row[:5])
                size, last = size + len(row[4]), row[5]
        if rows:
            yield repeats_in(rows)

    return cuts.mapInPandas(run, "doc long, tag long, low long, high long")


def strings_of(cuts: DataFrame) -> DataFrame:
    """(h, l, doc, tag, start): every string of the segments, as a hash in two halves."""
    columns = ["h", "l", "doc", "tag", "start"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, tag, start, count, cut in zip(*(batch[c] for c in ("doc", "tag", "start", "count", "segment"))):
                for k in range(count):
                    whole = hashlib.blake2b(cut[k : k + LENGTH], digest_size=16).digest()
                    rows.append((int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True), doc, tag, start + k))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return cuts.mapInPandas(run, "h long, l long, doc long, tag long, start long")


def hot_repeats(cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """The same as ``sort_shards`` for segments of anchors that are too large for one task: a minimum
    for each hash, made in parts, and a join whose large keys can be split."""
    cuts = scratch.save(cuts, "hot")
    at = F.struct("doc", "tag", "start")
    first = strings_of(cuts).groupBy("h", "l").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first.select("h", "l", "at"), "first")
    later = strings_of(cuts).join(first.hint("merge"), ["h", "l"]).where(at > F.col("at"))
    return later.select("doc", "tag", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))


def cut_texts(texts: DataFrame) -> DataFrame:
    """doc, tag, n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept, of texts with their ranges."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, tag, text, lows, highs in zip(*(batch[c] for c in ("doc", "tag", "bytes", "lows", "highs"))):
                kept, at, spans = [], 0, 0
                for low, high in sorted(zip(lows, highs)) if lows is not None else ():
                    if low > at or not spans:
                        kept.append(text[at:low])
                        spans += 1
                    at = max(at, high)
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((doc, tag, len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(rows, columns=["doc", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInPandas(run, "doc long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, kept."""
    scratch = Scratch(docs.sparkSession, "suffix")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    # The tag of a null id is not negative, that of any other is: nulls come last, whatever the ids.
    hashed = F.xxhash64("bytes")
    tag = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(hashed, 1)).otherwise(hashed.bitwiseOR(F.lit(-(2**63))))
    raw = raw.select("*", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), tag.alias("tag"), F.sha2("bytes", 256).alias("digest"))
    place = F.struct("doc", "tag")
    firsts = scratch.save(raw.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "firsts")
    first = F.coalesce("first", place) == place
    rows = raw.join(small(firsts, 96, MARKS_BYTES), "digest", "left")
    texts = rows.where(first & (F.octet_length("bytes") >= LENGTH)).select("doc", "tag", "bytes")

    found = anchors(texts)
    shared = scratch.save(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    of_text = scratch.save(marks(found.join(shared, "anchor", "left_semi")), "marks")
    scratch.drop("anchors")
    # Always a merge join: the marks grow with the texts, and their plan must not depend on the size.
    marked = lambda table: texts.join(table.hint("merge"), ["doc", "tag"])
    places = scratch.save(cut_segments(marked(of_text), False), "places")
    scratch.drop("marks")
    order = F.struct("doc", "tag", "start", "count")
    earliest = places.groupBy("anchor", "same").agg(F.min(order).alias("at"))
    earliest = scratch.save(earliest, "earliest")
    # What is not the earliest of its equals is a repeat from end to end.
    later = places.join(earliest, ["anchor", "same"]).where(order > F.col("at"))
    later = later.select("doc", "tag", F.col("start").cast("long").alias("low"), (F.col("start") + F.col("count") - 1 + LENGTH).cast("long").alias("high"))
    # At most one anchor for every HOT bytes of segments.
    hot = scratch.save(earliest.groupBy("anchor").agg(F.sum(F.col("at.count") + LENGTH).alias("size")).where(F.col("size") > HOT).select("anchor"), "hot_anchors")
    some = bool(hot.head(1))
    cold = earliest.join(small(hot, 16), "anchor", "left_anti") if some else earliest
    distinct = scratch.save(marks(cold.select("anchor", "at.*")), "distinct")
    cuts = cut_segments(marked(distinct), True).repartition("anchor").sortWithinPartitions("anchor")
    sorted_out = scratch.save(sort_shards(cuts), "sorted")
    if some:
        distinct = scratch.save(marks(earliest.join(small(hot, 16), "anchor", "left_semi").select("anchor", "at.*")), "hot_distinct")
        later = later.unionByName(hot_repeats(cut_segments(marked(distinct), True), scratch))
    ranges = sorted_out.unionByName(later).groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("r"))
    ranges = scratch.save(ranges.select("doc", "tag", F.col("r.low").alias("lows"), F.col("r.high").alias("highs")), "ranges")
    scratch.drop("places", "earliest", "hot_anchors", "distinct", "sorted", "hot_distinct", "hot", "first")

    own = rows.where(first).select("doc_id", "doc", "tag", "bytes").join(ranges.hint("merge"), ["doc", "tag"], "left")
    kept = cut_texts(own)
    copies = rows.where(~first)
    gone = F.octet_length("bytes") >= LENGTH
    left = F.when(gone, F.lit(b"")).otherwise(F.col("bytes"))
    copies = copies.select(
        "doc", "tag", F.octet_length("bytes").cast("long").alias("n_bytes"), F.when(gone, F.octet_length("bytes")).otherwise(0).cast("long").alias("n_removed"),
        gone.cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), left.alias("kept"),
    )
    out = kept.unionByName(copies)
    return out.select(F.when(F.col("tag") < 0, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op2_suffix_repeats(spark, sf_dir):
    """What is left of every document without strings of 100 bytes that start earlier."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
