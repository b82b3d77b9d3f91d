"""Vectorised hashes of words and shingles, computed per Arrow batch with numpy.

A word's hash is a polynomial over per-byte random numbers modulo 2^64, read off prefix sums, then
mixed. Work goes through buffers of about ``BUFFER`` bytes cut between words, so a very long text
needs memory for its word hashes only.
"""

from __future__ import annotations

import ctypes
import gc
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIBC = ctypes.CDLL(None)
BUFFER = 1 << 18
#: Bytes of text whose shingles are held at a time; a single longer text is a portion of its own.
PORTION = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SHINGLE = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_numbers() -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    table[65:91] = table[97:123]
    return table


NUMBERS = byte_numbers()


@lru_cache(maxsize=2)
def powers(length: int, base: int = BASE) -> np.ndarray:
    steps = np.full(length, base, dtype=U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    room = max(BUFFER * 2, 1 << (length - 1).bit_length())
    return powers(room), powers(room, pow(BASE, -1, 1 << 64))


def _buffer_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one buffer."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    ahead, back = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(NUMBERS[raw] * ahead[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` and, for each text, where its words start (one more at the end)."""
    hashes, counts, held, size = [], np.zeros(len(texts), dtype=np.int64), [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            found, starts = _buffer_hashes(b" ".join(part for _, part in held))
            begins = np.cumsum([0] + [len(part) + 1 for _, part in held])
            owners = np.array([i for i, _ in held])[np.searchsorted(begins, starts, side="right") - 1]
            np.add.at(counts, owners, 1)
            hashes.append(found)
        held, size = [], 0

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BUFFER:
                # Cut a long text at the last blank before the limit, or at the next one after it.
                cuts = [text.rfind(b, at, at + BUFFER) for b in (b" ", b"\n")]
                end = max(cuts) if max(cuts) > at else min((c for b in (b" ", b"\n") if (c := text.find(b, at + BUFFER)) >= 0), default=end)
            held.append((i, text[at:end]))
            size += end - at
            at = end
            if size >= BUFFER:
                flush()
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64), np.concatenate([[0], np.cumsum(counts)])


def release() -> None:
    """What this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def released(run):
    """``run`` over the batches of a task, and then ``release``: Spark uses a worker again for later stages,
    beside whatever the allocators of earlier ones keep for themselves."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def portions(sizes) -> list[slice]:
    """Slices of adjacent rows with at most ``PORTION`` bytes of text each, or one row."""
    cuts, held = [0], 0
    for i, size in enumerate(sizes):
        if held and held + size > PORTION:
            cuts.append(i)
            held = 0
        held += size
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)]) if a < b]


def arrow_parts(batches, column: str = "text"):
    """The Arrow batches cut into parts with at most ``PORTION`` bytes of a text column (or one row);
    nothing comes of empty batches."""
    for batch in batches:
        for part in portions(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            yield batch.slice(part.start, part.stop - part.start)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the ``width``-word shingles of each text; the whole sequence of a
    shorter text is its only shingle, and a text without words has none."""
    words, starts = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(n, dtype=U64)
    for k in range(width):
        rolled[: n - k] += words[k:] * SHINGLE[k]
    rolled = mix(rolled + U64(width))
    sets = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            sets.append(mix((words[a:b] * SHINGLE[: b - a]).sum(keepdims=True, dtype=U64) + U64(b - a)))
        else:
            sets.append(np.zeros(0, dtype=U64))
    return sets
