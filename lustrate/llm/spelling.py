"""Spelling variants: words one edit apart, found by Levenshtein automata on compact trie shards.

Runs of letters are counted within tasks and then by Spark. The distinct words are sorted over tasks and
compiled into tries of at most ``SHARD_WORDS`` words and ``SHARD_LETTERS`` letters each, kept as rows of
a table. Tries of at most ``WAVE`` bytes together are broadcast at a time; tasks intersect the distance-one
automaton of each of their words with every such trie, depth-first: along the path that spells the word,
at each depth first all states that have used their one edit there are followed to their end, and only
then does the path go on. An edit is taken in one place of a run of equal letters only, so no neighbour
is met twice. A task reduces what a word found in a wave to one row (how many, the best), and Spark reduces
the rows of all waves. Roots come from doubling the pointers: a form has twice its word's count, so chains
are as long as the logarithm of the highest count at most.

Results for odd input: null texts have no runs; a null doc_id stands as an empty string before the colon;
texts of any length are read by runs of about a million letters; rows that share an id, and repeated rows, count each;
other columns are passed over; ties for the best form go to the smallest word in code-point order; tables
without words give no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustrate.llm.hashing import arrow_parts
from lustrate.scratch import Scratch, spread

#: Words and letters of a trie, bytes of tries broadcast at a time, and words looked up together.
SHARD_WORDS, SHARD_LETTERS, WAVE, TOGETHER = 1 << 16, 1 << 20, 32 << 20, 2048
#: Words that a task counts before it passes them on, and letters read at a time.
MEMO, PIECE = 400_000, 1 << 20
LEAST_LENGTH, LEAST_COUNT, ONE_IN = 5, 3, 97
RUN = re.compile("[a-zÀ-ÿ]+")
CODE_BITS = 21


def runs_of(text: str):
    """Lists of the runs of a text, A-Z lower-cased (bytes.lower changes no others)."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        # No run is cut: the piece goes on to the next blank.
        end = len(text) if end == len(text) or (blank := text.find(" ", end)) < 0 else blank
        yield RUN.findall(text[at:end].encode("utf-8").lower().decode("utf-8"))
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, some runs with a letter left out, as the contract says."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in arrow_parts(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for runs in runs_of(text or ""):
                    for word, n in Counter(runs).items():
                        if len(word) < LEAST_LENGTH:
                            continue
                        h = zlib.crc32(word.encode("utf-8"), start)
                        if h % ONE_IN == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        seen[word] += n
                if len(seen) > MEMO:
                    yield rows()
                    seen = Counter()
        yield rows()

    counted = spread(docs.select("doc_id", "text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, where each word starts, and its length."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    return flat, np.cumsum(sizes) - sizes, sizes


class Trie:
    """A trie of sorted distinct words. Arc k leads to node k + 1; ``arcs`` holds its parent and code
    point as one rising number, so a search finds a child and the children of a node lie side by side."""

    def __init__(self, arcs: np.ndarray, ends: np.ndarray, n: np.ndarray, words: list[str]):
        self.arcs, self.ends, self.n, self.words = arcs, ends, n, words
        edges = np.searchsorted(arcs, np.arange(len(ends) + 1) << CODE_BITS)
        self.first, self.last = edges[:-1], edges[1:]

    @classmethod
    def build(cls, words: list[str], n: np.ndarray) -> Trie:
        flat, starts, sizes = codes_of(words)
        rows, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        arcs, ends, nodes, depth = [], [np.full(1, -1, np.int64)], 1, 0
        while len(rows := rows[keep := sizes[rows] > depth]):
            key = node[keep] << CODE_BITS | flat[starts[rows] + depth]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            node = nodes + np.cumsum(fresh) - 1
            arcs.append(key[fresh])
            end = np.full(int(fresh.sum()), -1, dtype=np.int64)
            done = sizes[rows] == depth + 1
            end[node[done] - nodes] = rows[done]
            ends.append(end)
            nodes, depth = nodes + len(end), depth + 1
        return cls(np.concatenate([np.zeros(0, np.int64), *arcs]), np.concatenate(ends), n, words)

    def to_bytes(self) -> bytes:
        text = "\n".join(self.words).encode("utf-8")
        parts = [self.arcs.tobytes(), self.ends.astype(np.int32).tobytes(), self.n.tobytes(), text]
        return struct.pack("<4q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def of_bytes(cls, data: bytes) -> Trie:
        at, parts = 32, []
        for size in struct.unpack_from("<4q", data):
            parts.append(data[at : at + size])
            at += size
        return cls(np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.int32).astype(np.int64), np.frombuffer(parts[2], np.int64), parts[3].decode("utf-8").split("\n"))

    def child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by a code point, or -1."""
        if not len(self.arcs):
            return np.full(len(node), -1, dtype=np.int64)
        key = node << CODE_BITS | code
        at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        return np.where(self.arcs[at] == key, at + 1, -1)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, place of a neighbour) of all pairs that are exactly one edit apart."""
        flat, starts, sizes = codes_of(words)
        found_words, found = [], []

        def follow(word: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
            """States that have used their edit: the rest of the word must be spelled below ``node``."""
            while len(word):
                done = at == sizes[word]
                ends = self.ends[node[done]]
                found_words.append(word[done][ends >= 0])
                found.append(ends[ends >= 0])
                word, node, at = word[~done], node[~done], at[~done]
                node = self.child(node, flat[starts[word] + at])
                there = node >= 0
                word, node, at = word[there], node[there], at[there] + 1

        word, node, depth = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), 0
        while len(word):
            inside = sizes[word] > depth
            here = flat[np.where(inside, starts[word] + depth, 0)] if len(flat) else np.zeros(len(word), np.int64)
            before = flat[starts[word] + depth - 1] if depth else np.full(len(word), -1)
            # One letter left out: the first of a run of equal ones.
            cut = inside & (here != before)
            follow(word[cut], node[cut], np.full(int(cut.sum()), depth + 1))
            # All children, for a letter replaced and for one put in (not after an equal one).
            fan = self.last[node] - self.first[node]
            of = np.repeat(np.arange(len(word)), fan)
            arc = np.arange(len(of)) - np.repeat(np.cumsum(fan) - fan, fan) + self.first[node][of]
            code = self.arcs[arc] & ((1 << CODE_BITS) - 1)
            other = inside[of] & (code != here[of])
            follow(word[of[other]], arc[other] + 1, np.full(int(other.sum()), depth + 1))
            fresh = code != before[of]
            follow(word[of[fresh]], arc[fresh] + 1, np.full(int(fresh.sum()), depth))
            word, node, here = word[inside], node[inside], here[inside]
            node = self.child(node, here)
            word, node, depth = word[node >= 0], node[node >= 0], depth + 1
        return np.concatenate([np.zeros(0, np.int64), *found_words]), np.concatenate([np.zeros(0, np.int64), *found])


def trie_shards(words: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """(shard, size, trie): tries of neighbouring words, each bounded in words and letters."""
    parts = max(1, -(-total // SHARD_WORDS))
    ordered = words.repartitionByRange(parts, "word").sortWithinPartitions("word")

    def compile_parts(batches):
        held: list[str] = []
        counts: list[int] = []
        letters = 0

        def shard():
            data = Trie.build(held, np.array(counts, dtype=np.int64)).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["size", "trie"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if held and (len(held) == SHARD_WORDS or letters + len(word) > SHARD_LETTERS):
                    yield shard()
                    held, counts, letters = [], [], 0
                held.append(word)
                counts.append(n)
                letters += len(word)
        if held:
            yield shard()

    return scratch.save(ordered.mapInArrow(compile_parts, "size long, trie binary").withColumn("shard", F.monotonically_increasing_id()), "tries")


def waves_of(shards: DataFrame):
    """Lists of shards that are broadcast together: at most ``WAVE`` bytes, or one shard."""
    held, size = [], 0
    for row in shards.select("shard", "size").orderBy("shard").toLocalIterator():
        if held and size + row["size"] > WAVE:
            yield held
            held, size = [], 0
        held.append(row["shard"])
        size += row["size"]
    if held:
        yield held


def near_in(words: DataFrame, tries) -> DataFrame:
    """What each word finds in the tries of one wave: (word, n_near, best_n, best)."""

    def search(batches):
        shards = [Trie.of_bytes(x) for x in tries.value]
        for batch in batches:
            every = batch.column("word").to_pylist()
            for low in range(0, len(every), TOGETHER):
                some, rows = every[low : low + TOGETHER], []
                for trie in shards:
                    word, near = trie.near(some)
                    # The largest count first, then the smallest word (words of a trie are sorted).
                    order = np.lexsort([near, -trie.n[near], word])
                    word, near = word[order], near[order]
                    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
                    total = np.diff(np.append(first, len(word)))
                    rows += [(some[w], t, c, trie.words[k]) for w, t, c, k in zip(word[first].tolist(), total.tolist(), trie.n[near[first]].tolist(), near[first].tolist())]
                names, kinds = ["word", "n_near", "best_n", "best"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names)

    return words.select("word").mapInArrow(search, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, best_n, best) of each word that has a neighbour; ``words`` is a saved table."""
    spark, total = words.sparkSession, words.count()
    shards = trie_shards(words, scratch, total)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (8 * TOGETHER)))
    dealt = scratch.save(words.repartition(tasks, "word"), "dealt").repartition(tasks, "word")
    found = None
    for i, wave in enumerate(waves_of(shards)):
        tries = spark.sparkContext.broadcast([bytes(r["trie"]) for r in shards.where(F.col("shard").isin(wave)).select("trie").collect()])
        part = scratch.save(near_in(dealt, tries), f"near{i}")
        tries.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best_n", "b.best")


def roots(forms: DataFrame, highest: int, scratch: Scratch) -> DataFrame:
    """(word, root) of words that have a form: pointers are doubled until the longest chain is passed."""
    ends, steps = scratch.save(forms.select("word", F.col("form").alias("root")), "roots0"), 1
    # A form's count is twice its word's at least.
    while steps < highest.bit_length():
        further = ends.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        ends = ends.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"))
        steps *= 2
        ends = scratch.save(ends, f"roots{steps}")
    return ends


def group_spellings(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs), "words")
    near = words.join(near_words(words, scratch), "word", "left")
    follows = F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False))
    formed = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n"))
    formed = scratch.save(formed, "formed")
    highest = words.agg(F.max("n")).first()[0] or 0
    ends = roots(formed.where("form IS NOT NULL"), highest, scratch)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return group_spellings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents
), each AS (
  SELECT run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), summed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) % 256) + 1])), 4294967295) AS crc FROM each, steps
), changed AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, c FROM summed
), words AS (SELECT word, sum(c)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cuts AS (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS short FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.short = b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN cuts b ON a.i = b.i AND a.short = b.short AND length(a.word) = length(b.word) AND a.word <> b.word
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min({'w': other, 'n': w.n}, {'n': -w.n, 'w': encode(other)}) AS b FROM near JOIN words w ON w.word = other GROUP BY near.word
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * n THEN b.w END AS form, CASE WHEN b.n >= 2 * n THEN b.n END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.at WHERE form IS NOT NULL
), ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed f ON f.word = chain.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
