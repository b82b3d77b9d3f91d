"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Sizes are whole numbers from 1 to ``capacity``, so the instance is a histogram of at most ``capacity``
counts, however many documents there are; the driver holds that histogram and never a document.

Reduction (on the histogram, many bins at a time): for an item j let j* be the largest other item that
fits beside it. A set that holds j is dominated by {j} if nothing fits; by {j, j*} if only one more item
fits, if both fill the sequence, or if no three fit and no two that fit outweigh j*; and by {j, j*, jb}
(jb the largest that still fits) if no three fit and of every two that fit, the smaller is no larger than
jb or both together don't outweigh j*. Such sets are fixed for good; they are part of some best packing of
what was left. Each step uses up a size, and steps are repeated until none applies. The remainder goes
by decreasing best fit: the fullest sequence that has room, equal sequences being one entry with a
number. The plan's entries (size, first rank, sequences) are bounded by the capacity alone.

Pieces get their rank among the pieces of their size from two levels of sums (within a task, then over
the tasks of a size), and find their sequence and offset in the plan by a search. No step holds all
pieces of a size together.

Results for odd input: a null or empty text is the end token alone, one piece of length 1; very long
texts are encoded in portions and cut into pieces of ``capacity`` tokens; repeated rows and rows that
share an id are packed each by itself; doc_id may have any type, null included; other columns are
passed over; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, IntegerType, StructField, StructType

from lustrate.llm.bpe import LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE, ragged
from lustrate.llm.hashing import arrow_parts
from lustrate.scratch import Scratch, small, spread

CAPACITY = 2048
#: The id after each document.
END = 0
#: Words and letters that a worker keeps, and letters of a text that are encoded at a time.
MEMO, MEMO_LETTERS, PORTION = 400_000, 16 << 20, 1 << 20


# The tokenizer's own pattern over lower-case letters of Latin-1, where lower-casing and
# composing change no letter in another way; other texts are cut at ASCII blanks only.
WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LATIN_LETTER}]+|[{LATIN_NUMBER}]|[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+")
#: Words that are encoded as one text.
JOINED = 500


class WordEncoder:
    """Ids of texts, word by word: the tokenizer drops white space and never merges over it, so each word
    is encoded by the library once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.sizes, self.letters = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def words(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
                return WORD.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return re.split("[\t-\r ]+", text)

    def know(self, words: list[str]) -> None:
        """Single words are encoded many as one text, and told apart by the tokens that end a word."""
        single = [w for w in words if WORD.fullmatch(w)]
        joined = self.tokenizer.encode_batch_fast([" ".join(single[i : i + JOINED]) for i in range(0, len(single), JOINED)], add_special_tokens=False)
        ids = np.array([i for e in joined for i in e.ids], dtype=np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(ends) != len(single):  # a word of several pieces among them: none is told apart
            single, ids, ends = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        rest = list(set(words).difference(single))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self.number.update(zip([*single, *rest], range(len(self.sizes), len(self.sizes) + len(words))))
        self.sizes = np.concatenate([self.sizes, np.diff(ends, prepend=0), np.array([len(x) for x in found], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in found for i in x], dtype=np.uint32)])
        self.letters += sum(map(len, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with ``END`` after them."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if len(self.number) > MEMO or self.letters > MEMO_LETTERS:
                self.forget()
            if fresh := list(set().union(*(w for _, w in held)).difference(self.number)):
                self.know(fresh)
            starts, get = np.cumsum(self.sizes) - self.sizes, self.number.__getitem__
            for i, words in held:
                at = np.array(list(map(get, words)), dtype=np.int64)
                out[i].append(ragged(self.ids, starts[at], self.sizes[at]))
            held, size = [], 0

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = text.find(" ", at + PORTION) if len(text) - at > PORTION else -1
                end = len(text) if end < 0 else end
                held.append((i, self.words(text[at:end])))
                size += end - at
                at = end
                if size > PORTION:
                    flush()
        flush()
        last = np.array([END], dtype=np.uint32)
        return [np.concatenate([*parts, last]).astype("<u4") for parts in out]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _block, _rank): every piece, with its rank among the
    pieces of its length in its task."""
    longs = [StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "_block", "_rank")]
    schema = StructType([docs.schema["doc_id"], StructField("piece", IntegerType()), *longs])

    def run(batches):
        encoder, seen, block = word_encoder(vocab_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in arrow_parts(batches):
            owner, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                for at in range(0, len(ids), capacity):
                    owner.append(i)
                    piece.append(at // capacity)
                    start.append(at)
                    length.append(min(capacity, len(ids) - at))
                    crc.append(zlib.crc32(ids[at : at + capacity]))
            rank = []
            for n in length:
                rank.append(int(seen[n]))
                seen[n] += 1
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, [block] * len(owner), rank)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def reduced(counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Sets fixed by dominance, as ({size: how many}, number of sequences), and the counts that are left."""
    counts, fixed = counts.copy(), []

    def largest(room: int) -> int:
        there = np.flatnonzero(counts[1 : room + 1]) if room > 0 else ()
        return int(there[-1]) + 1 if len(there) else 0

    def smallest_three(room: int) -> list[int]:
        out = []
        for s in np.flatnonzero(counts[1 : room + 1])[:3].tolist() if room > 0 else ():
            out += [s + 1] * min(3, int(counts[s + 1]))
        return out[:3]

    def pair_above(room: int, least_smaller: int, sum_above: int) -> bool:
        """Whether two items fit ``room`` of which the smaller exceeds ``least_smaller`` and whose sum
        exceeds ``sum_above``."""
        sizes = np.flatnonzero(counts[: room + 1])
        sizes = sizes[sizes > max(least_smaller, 0)]
        if not len(sizes):
            return False
        # The heaviest pair with each smaller item: the largest size within the room, itself only if there are two.
        at = np.searchsorted(sizes, room - sizes, side="right") - 1
        own = np.arange(len(sizes))
        at = np.where((at == own) & (counts[sizes] < 2), at - 1, at)
        fits = at >= own
        return bool((fits & (sizes + sizes[np.maximum(at, 0)] > sum_above)).any())

    def fix(j: int) -> bool:
        """One step for items of size j; the item itself is taken out while its partners are looked for."""
        room, n = capacity - j, int(counts[j])
        counts[j] -= 1
        mate, least = largest(room), smallest_three(room)
        only_one = len(least) < 2 or least[0] + least[1] > room
        only_two = len(least) < 3 or sum(least) > room
        third = 0
        if not mate:
            chosen: list[int] | None = []
        elif only_one or mate == room or (only_two and not pair_above(room, 0, mate)):
            chosen = [mate]
        elif only_two:
            counts[mate] -= 1
            third = largest(room - mate)
            counts[mate] += 1
            chosen = [mate, third] if third and not pair_above(room, third, mate) else None
        else:
            chosen = None
        counts[j] += 1
        if chosen is None:
            return False
        whole: dict[int, int] = {}
        for s in [j, *chosen]:
            whole[s] = whole.get(s, 0) + 1
        times = min(int(counts[s]) // k for s, k in whole.items())
        # Alone only while nothing fits, which fewer items of the same size can't change.
        times = n if not chosen else times
        for s, k in whole.items():
            counts[s] -= k * times
        fixed.append((whole, times))
        return True

    while True:
        before = len(fixed)
        for j in range(capacity, 0, -1):
            while counts[j] and fix(j):
                pass
        if len(fixed) == before:
            return fixed, counts


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Decreasing best fit of a histogram: equal sequences are one entry with their number."""
    open_by_room: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(room: int, entry: list) -> None:
        open_by_room.setdefault(room, []).append(entry)
        rooms[room] = True

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            fitting = np.flatnonzero(rooms[s:])
            if len(fitting):
                room = int(fitting[0]) + s
                whole, m = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms[room] = False
            else:
                whole, m, room = {}, -(-n // (capacity // s)), capacity
            # The next item of this size goes where the last one went, while it fits there.
            k = room // s
            full = min(m, n // k)
            if full:
                put(room - k * s, [whole | {s: k}, full])
            n, m = n - full * k, m - full
            if n and m:
                put(room - n * s, [whole | {s: n}, 1])
                n, m = 0, m - 1
            if m and whole:
                put(room, [whole, m])
    return [(whole, m) for entries in open_by_room.values() for whole, m in entries]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """How many sequences of each content: ({size: how many}, number of sequences)."""
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def entries_of(contents: list[tuple[dict[int, int], int]], capacity: int) -> np.ndarray:
    """The plan by size: rows (size, first rank, items in a sequence, first sequence, offset), sorted."""
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for whole, times in contents:
        offset = 0
        for s in sorted(whole, reverse=True):
            rows.append((s, int(used[s]), whole[s], sequence, offset))
            used[s] += whole[s] * times
            offset += whole[s] * s
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(pieces_of(docs, vocab_path, capacity), "pieces")
    blocks = scratch.save(pieces.groupBy("_block", "length").agg(F.count("*").alias("n")), "blocks")
    counts = np.zeros(capacity + 1, np.int64)
    for row in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    entries = entries_of(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.save(blocks.select("_block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "bases")
    placed = pieces.join(small(bases, 24), ["_block", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = StructType([*(pieces.schema[n] for n in names[:5]), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches):
        # Size and rank as one number: both are sorted by it, and a search finds the entry.
        wide = int(counts.max(initial=0)) + 1
        keys = entries[:, 0] * wide + entries[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = entries[np.searchsorted(keys, length * wide + rank, side="right") - 1] if len(entries) else entries
            ahead, each = rank - at[:, 1], at[:, 2]
            sequence, offset = at[:, 3] + ahead // each, at[:, 4] + ahead % each * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:5]), pa.array(sequence), pa.array(offset)], names)

    return placed.select(*names[:5], "_rank").mapInArrow(run, schema)


def op11_best_fit_packing(spark, sf_dir):
    """Packs every document into sequences of 2048 tokens of the public word vocabulary."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
