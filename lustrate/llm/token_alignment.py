"""Alignment of two tokenizers by a dangling-suffix transducer.

A text, with a space before it, is encoded by A (byte-level BPE) and by B (pieces with byte fallback).
Reading both sequences, the transducer's state is the side that leads and its bytes that the other
side has not matched yet; the side that lags reads its next token. Transitions are memoised by state
and token. Where nothing is left over, a group of tokens closes. Neither tokenizer merges across a
single space between two other characters, nor from a letter to a punctuation mark (A's words end there, and
no piece of B holds such a pair, which is looked up in its vocabulary), so groups close there too, and each
distinct stretch between such places goes through the transducer once for each fill of a worker's memo.

Counts of linked id pairs are taken over all documents: Spark explodes each document's distinct pairs
and counts them, combined within tasks. The most frequent pairs (a bounded table of at most ``PAIRS``
rows, by the lowest count that leaves no more) go to executors as one mapped file; all other pairs are
joined by a shuffle, and as they are the rare ones, no key of that join is hot.

Results for odd input: texts that are null, empty, or whose tokens do not spell the text (such as texts
with U+2581, which B takes for a space) have no tokens: zeros and an empty string in place of the
digest. Strings of special tokens are plain text. Very long texts are read in pieces of about a
million letters; repeated rows and rows that share an id are documents of their own; doc_id may have
any type, null included; other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lustrate.llm.bpe import PIECE, byte_letters, in_pieces, ragged
from lustrate.llm.hashing import arrow_parts
from lustrate.scratch import Scratch, spread

#: Most id pairs in the table that is sent to executors (13 bytes each).
PAIRS = 1 << 18
#: Words and letters that a worker keeps before it starts anew, and states of its transducer.
MEMO, MEMO_LETTERS, STATES = 400_000, 8 << 20, 1 << 17
#: Bits of a B id in the number of a pair.
B_BITS = 15


class Transducer:
    """Groups of two token sequences of the same bytes. State 0 has nothing left over; an even state
    holds bytes of A that B has yet to match, an odd one bytes of B."""

    def __init__(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.states, self.number, self.next = {0: (0, b"")}, {}, {}

    def learn(self, state: int, token: int) -> int | None:
        """The state after ``token`` of the side that reads in ``state``; None if the bytes differ."""
        leads, left = self.states[state]
        reads = 1 - leads if left else 0
        new = self.bytes[reads][token]
        if left.startswith(new):
            leads, left = leads, left[len(new) :]
        elif new.startswith(left):
            leads, left = reads, new[len(left) :]
        else:
            return None
        after = 0
        if left:
            after = self.number.setdefault((leads, left), 2 * len(self.states) + leads)
            self.states[after] = (leads, left)
        self.next[state << 17 | token] = after
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], dict[int, int]] | None:
        """The groups of two sequences, written, and how often each id pair is linked; None if they spell
        different bytes. Ids are counted within a large group, its pairs are not listed."""
        if len(self.states) > STATES:
            self.forget()
        state = i = j = i0 = j0 = 0
        get, written, links = self.next.get, [], {}
        try:
            for _ in range(len(a) + len(b)):
                if state & 1 or not state:
                    token = a[i]
                    i += 1
                else:
                    token = b[j]
                    j += 1
                after = get(state << 17 | token)
                if after is None and (after := self.learn(state, token)) is None:
                    return None
                state = after
                if state:
                    continue
                if i - i0 == 1 and j - j0 == 1:
                    x, y = a[i0], b[j0]
                    written.append(f"{x}|{y}")
                    key = x << B_BITS | y
                    links[key] = links.get(key, 0) + 1
                else:
                    some, other = a[i0:i], b[j0:j]
                    written.append(f"{','.join(map(str, some))}|{','.join(map(str, other))}")
                    if len(some) * len(other) > 16:
                        some, other = Counter(some).items(), Counter(other).items()
                    else:
                        some, other = [(x, 1) for x in some], [(y, 1) for y in other]
                    for x, n in some:
                        for y, m in other:
                            key = x << B_BITS | y
                            links[key] = links.get(key, 0) + n * m
                i0, j0 = i, j
        except IndexError:  # the side that lags has ended
            return None
        return None if state else (written, links)


#: Words that are encoded as one text.
JOINED = 500
#: Letters after which, and marks before which, a text may be cut (an apostrophe may begin a word of A's),
#: and the letter that stands before such a mark when it is encoded.
LETTERS, MARKS, LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]", "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~", "a"


def odd(word: str) -> bool:
    """Whether a word can't be encoded together with others."""
    word = word.removeprefix(" ")
    return word[:1].isspace() or word[-1:].isspace() or "▁" in word


def parted(ids: list[int], sizes: np.ndarray, ends: np.ndarray) -> list[list[int]] | None:
    """``ids`` of a text cut where its words end (in bytes), or None if a token goes over an end."""
    every = np.array(ids, dtype=np.int64)
    at = np.cumsum(sizes[every])
    cuts = np.searchsorted(at, ends)
    if not len(at) or cuts[-1] >= len(at) or (at[cuts] != ends).any():
        return None
    return [ids[x:y] for x, y in zip([0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist())]


class Aligner:
    """Both tokenizers and a memo of aligned words."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters, special = byte_letters(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        a_bytes = {i: t.encode() if t in special else bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items()}
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        if len(pieces) > 1 << B_BITS or len(a_bytes) > 1 << 16:
            raise ValueError("a vocabulary is too large for the numbers of pairs")
        # Words are aligned one by one only because no piece goes on over a space.
        if any("▁" in p.lstrip("▁") for _, p in pieces):
            raise ValueError("a piece of B spans words")
        pairs = {x[k : k + 2] for _, x in pieces for k in range(len(x) - 1)}
        marks = "".join(m for m in MARKS if not any(x[1] == m and re.fullmatch(LETTERS, x[0]) for x in pairs))
        self.cut = re.compile(rf"(?<=\S)(?= \S)|(?<={LETTERS})(?=[{re.escape(marks)}])" if marks else r"(?<=\S)(?= \S)")
        if any((self.a.encode(" " + LETTER + m).ids[1:] == []) or self.b.encode(LETTER + m)[1:] == [] for m in marks):
            raise ValueError("a mark does not stand by itself")
        self.transducer = Transducer(a_bytes, b_bytes)
        self.a_sizes, self.b_sizes = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (a_bytes, b_bytes))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str | None] = []
        self.counts = np.zeros((0, 3), dtype=np.int64)
        self.keys, self.times, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.letters = 0

    def encoded(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of words, each with a space before it (B adds that space itself). Words without white
        space at their ends are encoded many as one text: in it, too, no token goes over a space."""
        out: tuple[list, list] = ([], [])
        for low in range(0, len(words), JOINED):
            some = words[low : low + JOINED]
            ends = np.cumsum([len(w.encode("utf-8")) + 1 for w in some])
            text, parts = " ".join(some), None
            if not any(odd(w) for w in some):
                a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
                parts = parted(a, self.a_sizes, ends), parted(b, self.b_sizes, ends)
            if parts is None or None in parts:
                parts = [e.ids for e in self.a.encode_batch_fast([" " + w for w in some], add_special_tokens=False)], self.b.encode(some, num_threads=1)
            for x, y in zip(out, parts):
                x += y
        return out

    def know(self, fresh: list[str]) -> None:
        """Aligns stretches of text. One that begins with a space is encoded as the word after it, one that
        begins with a mark behind a letter, whose own tokens are then left out."""
        # Odd ones come last, so that they don't keep others from being encoded together.
        fresh = sorted(fresh, key=odd)
        a_ids, b_ids = self.encoded([x[1:] if x[0] == " " else LETTER + x for x in fresh])
        for i, x in enumerate(fresh):
            if x[0] != " ":
                del a_ids[i][0], b_ids[i][0]
        counts, keys, times, sizes, align = [], [], [], [], self.transducer.align
        for word, a, b in zip(fresh, a_ids, b_ids):
            found = align(a, b)
            written, links = found or ([], {})
            self.number[word] = len(self.written)
            self.written.append(";".join(written) if written else None)
            counts.append((len(a), len(b), len(written)))
            keys += links
            times += links.values()
            sizes.append(len(links))
        self.counts = np.concatenate([self.counts, np.array(counts, dtype=np.int64).reshape(-1, 3)])
        self.keys = np.concatenate([self.keys, np.array(keys, dtype=np.int32)])
        self.times = np.concatenate([self.times, np.array(times, dtype=np.int64)])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, dtype=np.int64)])
        self.letters += sum(map(len, fresh))

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, keys, times) of each text; the latter two are its
        distinct id pairs and how often each is linked."""
        totals, sums, links, whole = np.zeros((len(texts), 3), np.int64), [hashlib.sha256() for _ in texts], [[] for _ in texts], [bool(t) for t in texts]
        begun = [False] * len(texts)
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if len(self.number) > MEMO or self.letters > MEMO_LETTERS:
                self.forget()
            if fresh := list(set().union(*(w for _, w in held)).difference(self.number)):
                self.know(fresh)
            starts, get, written = np.cumsum(self.sizes) - self.sizes, self.number.__getitem__, self.written.__getitem__
            for i, words in held:
                at = list(map(get, words))
                strings = list(map(written, at))
                if None in strings:
                    whole[i] = False
                    continue
                sums[i].update(f"{';' * begun[i]}{';'.join(strings)}".encode())
                begun[i] = True
                at = np.array(at, dtype=np.int64)
                totals[i] += self.counts[at].sum(axis=0)
                links[i].append(summed(ragged(self.keys, starts[at], self.sizes[at]), ragged(self.times, starts[at], self.sizes[at])))
            held, size = [], 0

        for i, text in enumerate(texts):
            for k, piece in enumerate(in_pieces(text)):
                # A later piece begins with the space before its first word.
                held.append((i, self.cut.split(piece if k else " " + piece)))
                size += len(piece)
                if size > PIECE:
                    flush()
        flush()
        out = []
        for i in range(len(texts)):
            if not whole[i]:
                out.append((0, 0, 0, 0, "", NONE, NONE))
                continue
            keys, times = summed(*map(np.concatenate, zip(*links[i]))) if len(links[i]) > 1 else links[i][0]
            out.append((*totals[i].tolist(), int(times.sum()), sums[i].hexdigest(), keys, times))
        return out


NONE = np.zeros(0, dtype=np.int64)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of ``times`` of each."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(times, first) if len(first) else times


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, _row, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct id pairs: ``keys``
    (A's id, then B's in the low bits) with ``times``."""
    counts = [StructField(n, LongType()) for n in ("_row", "n_a", "n_b", "n_groups", "n_links")]
    schema = StructType([docs.schema["doc_id"], *counts, StructField("groups_sha256", StringType()), StructField("keys", ArrayType(IntegerType())), StructField("times", ArrayType(LongType()))])

    def run(batches):
        both = aligner(a_path, b_path)
        for batch in arrow_parts(batches):
            rows = both.align([t or "" for t in batch.column("text").to_pylist()])
            n_a, n_b, n_groups, n_links, sha, keys, times = zip(*rows)
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((keys, pa.int32()), (times, pa.int64()))]
            columns = [batch.column("doc_id"), batch.column("_row"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(sha, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return spread(docs.select("doc_id", "text")).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def pair_table(rows: DataFrame) -> DataFrame:
    """(key, n, best): in how many documents each id pair is linked, and whether that is the highest
    count of its A id. Each document lists a pair once."""
    counts = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return counts.withColumn("a", F.shiftright("key", B_BITS))


def scored(rows: DataFrame, pairs: DataFrame, scratch: Scratch, limit: int = PAIRS) -> DataFrame:
    """``rows`` with n_best and count_sum from ``pairs`` (saved tables)."""
    spark, left, least = rows.sparkSession, limit, None
    for row in pairs.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():
        if (left := left - row["count"]) < 0:
            break
        least = 2 ** row["power"]
    table = pairs.where(F.col("n") >= least if least else F.lit(False)).select("key", "n", "best").toPandas().sort_values("key")
    data = [np.array([len(table)], np.int64), table["n"].to_numpy(np.int64), table["key"].to_numpy(np.int32), table["best"].to_numpy(np.bool_)]
    name = f"pairs-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(scratch.write_bytes(name, b"".join(x.tobytes() for x in data)))
    kept = [c for c in rows.columns if c not in ("keys", "times")]
    schema = StructType([rows.schema[c] for c in kept] + [StructField("n_best", LongType()), StructField("count_sum", LongType())])
    rest = StructType([StructField("_row", LongType()), StructField("key", IntegerType()), StructField("t", LongType())])

    def looked_up(batches, others: bool):
        raw = np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r")
        size = int(raw[:8].view(np.int64)[0])
        counts, known, best = raw[8 : 8 + 8 * size].view(np.int64), raw[8 + 8 * size : 8 + 12 * size].view(np.int32), raw[8 + 12 * size :].view(np.bool_)
        for batch in batches:
            lists = batch.column("keys")
            keys, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, keys), max(size - 1, 0))
            there = known[at] == keys if size else np.zeros(len(keys), dtype=bool)
            if others:
                ids = batch.column("_row").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[~there]], pa.int64()), pa.array(keys[~there], pa.int32()), pa.array(times[~there], pa.int64())], rest.names)
                continue
            n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            at, owner, times = at[there], owner[there], times[there]
            np.add.at(n_best, owner, times * best[at])
            np.add.at(total, owner, times * counts[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best), pa.array(total)], schema.names)

    out = rows.mapInArrow(lambda batches: looked_up(batches, False), schema)
    if left >= 0:
        return out
    others = rows.select("_row", "keys", "times").mapInArrow(lambda batches: looked_up(batches, True), rest)
    joined = others.join(pairs.select("key", "n", "best"), "key")
    sums = joined.groupBy("_row").agg(F.sum(F.col("t") * F.col("best").cast("long")).alias("b"), F.sum(F.col("t") * F.col("n")).alias("s"))
    added = {"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}
    return out.join(sums, "_row", "left").withColumns(added).drop("b", "s")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, limit: int = PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "align")
    rows = scratch.save(aligned(docs, a_path, b_path), "rows")
    counts = scratch.save(pair_table(rows), "counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    pairs = scratch.save(counts.join(highest, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    out = scored(rows, pairs, scratch, limit)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir):
    """Aligns the public byte-level and piece vocabularies over every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
