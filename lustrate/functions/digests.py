"""Digests for identities: SHA-256 by default (built in), BLAKE3 for packs that need its ids."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published BLAKE3 specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16
MASK = 0xFFFFFFFF


def _quarter(v: list[int], a: int, b: int, c: int, d: int, x: int, y: int) -> None:
    for word, first, second in ((x, 16, 12), (y, 8, 7)):
        v[a] = (v[a] + v[b] + word) & MASK
        v[d] ^= v[a]
        v[d] = (v[d] >> first | v[d] << (32 - first)) & MASK
        v[c] = (v[c] + v[d]) & MASK
        v[b] ^= v[c]
        v[b] = (v[b] >> second | v[b] << (32 - second)) & MASK


def _compress(chain, block: bytes, counter: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*chain, *IV[:4], counter & MASK, counter >> 32, len(block), flags]
    for turn in range(7):
        for i in range(4):
            _quarter(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _quarter(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[p] for p in PERMUTATION] if turn < 6 else m
    return [v[i] ^ v[i + 8] for i in range(8)]


def _node(data: bytes, key, flags: int, at: int, root: int) -> list[int]:
    if len(data) <= 1024:
        blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        chain = key
        for i, block in enumerate(blocks):
            last = i == len(blocks) - 1
            chain = _compress(chain, block, at, flags | (CHUNK_START if i == 0 else 0) | ((CHUNK_END | root) if last else 0))
        return chain
    # The left part is the largest power of two of chunks that leaves something to the right.
    half = 1024 << ((len(data) - 1) // 1024).bit_length() - 1
    pair = _node(data[:half], key, flags, at, 0) + _node(data[half:], key, flags, at + half // 1024, 0)
    return _compress(key, struct.pack("<16I", *pair), 0, flags | PARENT | root)


def blake3(data: bytes, key: bytes | None = None) -> bytes:
    """BLAKE3-256 of ``data``, keyed if a 32-byte key is given."""
    words = struct.unpack("<8I", key) if key else IV
    return struct.pack("<8I", *_node(data, words, KEYED if key else 0, 0, ROOT))


class Blake3:
    """BLAKE3-256 of data that comes piece by piece; holds one chunk and one node for each level."""

    def __init__(self):
        self.left, self.chunks, self.stack = b"", 0, []

    def update(self, data: bytes) -> None:
        self.left += data
        while len(self.left) > 1024:  # the last chunk stays, as it may be the root
            node, self.left = _node(self.left[:1024], IV, 0, self.chunks, 0), self.left[1024:]
            self.chunks += 1
            done = self.chunks
            while done % 2 == 0:
                node, done = _compress(IV, struct.pack("<16I", *self.stack.pop(), *node), 0, PARENT), done // 2
            self.stack.append(node)

    def digest(self) -> bytes:
        stack = list(self.stack)
        node = _node(self.left, IV, 0, self.chunks, 0 if stack else ROOT)
        while stack:
            left = stack.pop()
            node = _compress(IV, struct.pack("<16I", *left, *node), 0, PARENT | (0 if stack else ROOT))
        return struct.pack("<8I", *node)


def fold(pieces: Iterable[bytes | None], method: str = "sha2-256") -> tuple[bytes, int]:
    """Digest of the pieces in their order (null ones add nothing), never held together, and their number."""
    state, n = Blake3() if method == "blake3" else hashlib.sha256(), 0
    for piece in pieces:
        n += 1
        if piece is not None:
            state.update(piece)
    return state.digest(), n


@F.pandas_udf(StringType())
def blake3_hex(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else blake3(bytes(x)).hex())


def digest(data: Column, method: str = "sha2-256") -> Column:
    """Lower-case hex digest of a binary or string column."""
    return F.sha2(data.cast("binary"), 256) if method == "sha2-256" else blake3_hex(data.cast("binary"))
