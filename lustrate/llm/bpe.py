r"""Byte-level BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The vocabulary is a given tokenizer file; nothing is trained. Word counts over all documents (one
shuffle) choose the frequent words: the lowest count whose words number at most ``lexicon`` in all.
Their encodings are compiled into a minimal acyclic transducer (states with equal futures are
shared; the numbers on the arcs add up to a word's place in a table of ids). It is written to one
file, sent to every executor by Spark, and memory-mapped there, so workers on a machine share it.
Words outside it are merged exactly by rank. Each worker keeps a bounded memo of words.

Special tokens' strings inside a text become their ids, as the tokenizers library does by default.
Results for odd input: a null or empty text has no tokens (the hash of no bytes); very long words
are merged with a heap, and texts are taken in portions of a few megabytes (a longer text is a
portion of its own); repeated rows are encoded alike; doc_id may have any type, null included, and
is carried; a table, or a part of one, without rows gives none; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import uuid
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lustrate.llm.hashing import arrow_parts, release, released
from lustrate.scratch import Scratch, spread

#: Most words of the transducer: it bounds the driver's work and the file sent to executors.
LEXICON = 65_536
#: Words that a worker keeps before it starts anew, and their letters.
MEMO, MEMO_LETTERS = 400_000, 8 << 20
#: Letters encoded together, and ids written or decoded together (these bound a worker's memory).
PIECE, BLOCK = 1 << 20, 1 << 17
#: Bytes of a word from which it is merged by itself, with a heap.
SHORT = 48
ID_BITS = 20
ID_MASK, NO_MERGE = (1 << ID_BITS) - 1, 1 << 60

# The pre-tokenizer's pattern over classes of letters, numbers and white space; the
# second form is for texts of Latin-1 letters only, which the standard library matches faster.
SPACE = r"\t-\r \x85\xa0  -     　"
LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"


def word_pattern(letter: str, number: str, space: str) -> str:
    # No alternative but the second begins with an apostrophe that a letter follows, so letters, the
    # most frequent kind, are tried before it.
    return rf" ?[{letter}]++|'(?:[stmd]|re|ve|ll)| ?[{number}]++| ?[^{space}{letter}{number}]++|[{space}]+(?![^{space}])|[{space}]+"


WORD = regex.compile(word_pattern(r"\p{L}", r"\p{N}", SPACE))
LATIN_WORD = re.compile(word_pattern(LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE))


SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def pretokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD.findall(text)
    return LATIN_WORD.findall(text)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one after the other; made in blocks, so
    that only the result grows with its size."""
    out = []
    for low in range(0, len(starts), BLOCK):
        first, size = starts[low : low + BLOCK], lengths[low : low + BLOCK]
        shift = (first - (np.cumsum(size) - size)).astype(np.int32)
        out.append(values[np.repeat(shift, size) + np.arange(int(size.sum()), dtype=np.int32)])
    return np.concatenate(out) if out else values[:0]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def table_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all parts, where each starts, and its size."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


class Vocabulary:
    """Ranks of merges, bytes of tokens and special strings of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        plain = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.bytes = {i: plain(token) for token, i in ids.items()}
        self.byte_ids = [0] * 256
        for token, i in ids.items():
            if len(token) == 1:
                self.byte_ids[letters[token]] = i
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            # One number orders by rank and carries the new id in its low bits.
            self.merges[ids[left], ids[right]] = rank << ID_BITS | ids[left + right]
        pairs = np.array([(left << ID_BITS | right, value) for (left, right), value in self.merges.items()] + [(1 << 62, NO_MERGE)], dtype=np.int64)
        self.pair_keys, self.pair_values = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.first = np.array(self.byte_ids, dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        # The same as tables: bytes and decimal numbers of all ids, one after the other.
        each = range(max(self.bytes) + 1)
        self.raw, self.raw_starts, self.raw_sizes = table_of([self.bytes.get(i, b"") for i in each])
        self.names, self.name_starts, self.name_sizes = table_of([b"%d," % i for i in each])
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """The special strings of a text and what lies between them; nothing of an empty text."""
        if not any(s in text for s in self.special):
            return [text] if text else []
        return [p for p in self.special_split.split(text) if p]

    def written(self, ids: np.ndarray) -> bytes:
        """``ids`` as decimal numbers with a comma after each."""
        return ragged(self.names, self.name_starts[ids], self.name_sizes[ids]).tobytes()

    def decoded(self, ids: np.ndarray) -> bytes:
        return ragged(self.raw, self.raw_starts[ids], self.raw_sizes[ids]).tobytes()

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and new id of each pair, or ``NO_MERGE``."""
        key = left.astype(np.int64) << ID_BITS | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NO_MERGE)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words: all ids, and how many each word has. Words of one length take
        their next merge together, so their rows stay equally long until no pair is left in them."""
        lengths, done = np.array([len(w) for w in words], dtype=np.int64), []
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if length > SHORT:
                done += [(np.array([i]), np.array([self.merge(words[i])], dtype=np.int32)) for i in rows.tolist()]
                continue
            ids = self.first[np.frombuffer(b"".join([words[i] for i in rows.tolist()]), dtype=np.uint8).reshape(len(rows), length)]
            found = self.look(ids[:, :-1], ids[:, 1:])
            while len(rows):
                width = ids.shape[1]
                at = found.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
                best = found[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NO_MERGE)
                going = best != NO_MERGE
                done.append((rows[~going], ids[~going]))
                rows, ids, found, at, new = rows[going], ids[going], found[going], at[going], (best[going] & ID_MASK).astype(np.int32)
                column, every = np.arange(width - 1), np.arange(len(rows))[:, None]
                ids = ids[every, column + (column > at[:, None])]
                ids[every[:, 0], at] = new
                found = found[every, column[:-1] + (column[:-1] >= at[:, None])]
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
                found[left, at[left] - 1] = self.look(ids[left, at[left] - 1], new[left])
                found[right, at[right]] = self.look(new[right], ids[right, at[right] + 1])
        sizes = np.zeros(len(words), dtype=np.int64)
        for rows, ids in done:
            sizes[rows] = ids.shape[1]
        starts, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), dtype=np.int32)
        for rows, ids in done:
            out[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, sizes

    def merge(self, word: bytes) -> list[int]:
        """Exact merges of one word: always the lowest rank, the leftmost of equal ones."""
        ids, merges = [self.byte_ids[b] for b in word], self.merges
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get = merges.get
        found = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) != NO_MERGE:
            at = found.index(best)
            new = best & ID_MASK
            ids[at : at + 2] = (new,)
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], new), NO_MERGE)
            if at < len(found):
                found[at] = get((new, ids[at + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked positions, for words of any length."""
        n, merges = len(ids), self.merges
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := merges.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (found >> ID_BITS, i, ids[i], ids[after[i]], found & ID_MASK))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to ids, as the bytes of its file.

    Words are added in byte order; when the next word leaves a branch, its states are replaced by
    registered ones with the same arcs. An arc's number counts the words that sort before its branch
    within the state, so numbers along a path add up to the word's place.
    """
    words = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final, registered, path = [False], {}, [0]
    spare: list[int] = []

    def settle(down_to: int, previous: bytes) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            same = registered.setdefault((final[state], tuple(arcs[state].items())), state)
            if same != state:
                arcs[path[-1]][previous[len(path) - 1]] = same
                arcs[state], final[state] = {}, False
                spare.append(state)

    previous = b""
    for word in words:
        shared = len(os.path.commonprefix([previous, word]))
        settle(shared, previous)
        for letter in word[shared:]:
            if spare:
                state = spare.pop()
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][letter] = state
            path.append(state)
        final[path[-1]] = True
        previous = word
    settle(0, previous)

    below: dict[int, int] = {}

    def count(state: int) -> int:
        # Words are short, so the depth of this recursion is that of the longest frequent word.
        if state not in below:
            below[state] = final[state] + sum(count(t) for t in arcs[state].values())
        return below[state]

    count(0)
    number, order = {0: 0}, [0]
    for state in order:
        for target in arcs[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
    # An arc's key is its state and letter, so the keys rise and a search finds the arc.
    arcs_out, targets, adds, ends = array("q"), array("i"), array("i"), array("i")
    for state in order:
        ends.append(final[state])
        so_far = int(final[state])
        for letter, target in sorted(arcs[state].items()):
            arcs_out.append(number[state] << 8 | letter)
            targets.append(number[target])
            adds.append(so_far)
            so_far += below[target]
    offsets, ids = array("i", [0]), array("i")
    for word in words:
        ids.extend(entries[word])
        offsets.append(len(ids))
    parts = [x.tobytes() for x in (arcs_out, targets, adds, ends, offsets, ids)]
    return struct.pack("<6q", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """The compiled transducer, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        parts, at = [], 48
        for size, kind in zip(struct.unpack_from("<6q", self.map), ("<i8", *["<i4"] * 5)):
            parts.append(np.frombuffer(self.map, dtype=kind, count=size // int(kind[-1]), offset=at))
            at += size
        self.arcs, self.targets, self.adds, self.ends, self.offsets, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of ids, or -1. All words take their next arc together."""
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts, out = np.cumsum(sizes) - sizes, np.full(len(words), -1, dtype=np.int64)
        rows, state, place = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for step in range(int(sizes.max(initial=0)) + 1):
            ended = sizes[rows] == step
            final = ended & (self.ends[state] > 0)
            out[rows[final]] = place[final]
            rows, state, place = rows[~ended], state[~ended], place[~ended]
            if not len(rows) or not len(self.arcs):
                break
            key = state << 8 | text[starts[rows] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            there = self.arcs[at] == key
            at, rows = at[there], rows[there]
            place, state = place[there] + self.adds[at], self.targets[at].astype(np.int64)
        return out

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at ``places``, and how many each has."""
        sizes = (self.offsets[places + 1] - self.offsets[places]).astype(np.int64)
        return ragged(self.ids, self.offsets[places], sizes), sizes


@lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def in_pieces(text: str):
    """A text in pieces of about ``PIECE`` letters. It is cut before single spaces between other
    characters: there a word begins, and nothing after it bears on the words before it."""
    at = 0
    while len(text) - at > PIECE and (cut := SINGLE_SPACE.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Encodes portions of texts, with a memo from words to their ids."""

    def __init__(self, lexicon: Lexicon | None, vocab: Vocabulary):
        self.lexicon, self.vocab = lexicon, vocab
        self.forget()

    def forget(self) -> None:
        """An empty memo, but for the special strings, which no other word is equal to."""
        self.number = {s: k for k, s in enumerate(self.vocab.special)}
        self.ids = np.array(list(self.vocab.special.values()), dtype=np.int32)
        self.sizes = np.ones(len(self.ids), dtype=np.int64)
        self.letters = 0

    def know(self, words: list[str]) -> None:
        """Words of the lexicon take their ids from it; the others are merged, all at once."""
        raw = [w.encode("utf-8") for w in words]
        place = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1)
        sizes, out = np.zeros(len(raw), dtype=np.int64), []
        known, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        if len(known):
            ids, sizes[known] = self.lexicon.ids_of(place[known])
            out.append(ids)
        ids, sizes[rest] = self.vocab.merge_many([raw[i] for i in rest.tolist()])
        order = np.concatenate([known, rest]).tolist()
        self.number.update(zip([words[i] for i in order], range(len(self.sizes), len(self.sizes) + len(order))))
        self.ids, self.sizes = np.concatenate([self.ids, *out, ids]), np.concatenate([self.sizes, sizes[order]])
        self.letters += sum(map(len, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
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
                at = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
                out[i].append(ragged(self.ids, starts[at], self.sizes[at]))
            held, size = [], 0

        for i, text in enumerate(texts):
            for part in self.vocab.split(text):
                for piece in [part] if part in self.vocab.special else in_pieces(part):
                    held.append((i, [piece] if part in self.vocab.special else pretokens(piece)))
                    size += len(piece)
                    if size > PIECE:
                        flush()
        flush()
        return [np.concatenate([np.zeros(0, dtype=np.int32), *x]) for x in out]


def word_counts(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(word, n) over all documents, counted within tasks before the shuffle."""

    def count(batches):
        vocab, seen = vocabulary(vocab_path), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in arrow_parts(batches):
            for text in batch.column("text").to_pylist():
                for part in vocab.split(text or ""):
                    for piece in in_pieces(part) if part not in vocab.special else ():
                        seen.update(pretokens(piece))
                        if len(seen) > MEMO:
                            yield rows()
                            seen = Counter()
        yield rows()

    return docs.select("text").mapInArrow(released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocab_path: str, scratch: Scratch, lexicon: int = LEXICON) -> list[str]:
    """The words above the lowest count (a power of 2) that leaves ``lexicon`` of them at most."""
    counts = scratch.save(word_counts(docs, vocab_path).where("n > 1 AND length(word) < 64"), "words")
    left, least = lexicon, None
    for row in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():
        if (left := left - row["count"]) < 0:
            break
        least = 2 ** row["power"]
    chosen = [] if least is None else [r["word"] for r in counts.where(F.col("n") >= least).select("word").collect()]
    scratch.drop("words")
    return chosen


def encode(docs: DataFrame, vocab_path: str, lexicon: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, and the ids themselves if asked."""
    spark = docs.sparkSession
    docs = spread(docs.select("doc_id", "text"))
    vocab = vocabulary(vocab_path)
    scratch = Scratch(spark, "bpe")
    chosen = frequent_words(docs, vocab_path, scratch, lexicon)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    data = compile_lexicon({w.encode("utf-8"): vocab.merge(w.encode("utf-8")) for w in chosen})
    # The file lies in the shared folder; Spark copies it to every executor, also to later ones.
    spark.sparkContext.addFile(scratch.write_bytes(name, data))
    del chosen, data
    release()  # what the compiler took on the driver

    fields = [docs.schema["doc_id"], *(StructField(n, t) for n, t in (("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType())))]
    schema = StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * with_ids)

    def run(batches):
        encoder = Encoder(mapped(name), vocabulary(vocab_path))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in arrow_parts(batches):
            vocab, ids = encoder.vocab, encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            sizes = [len(x) for x in ids]
            ids_sha = [sha(vocab.written(x)[:-1]) for x in ids]
            text_sha = [sha(vocab.decoded(x).decode("utf-8", "replace").encode("utf-8")) for x in ids]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(released(run), schema)


def op6_bpe_round_trip(spark, sf_dir):
    """Encodes and decodes every document with the public byte-level vocabulary."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
