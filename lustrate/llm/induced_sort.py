"""External induced sorting of suffixes up to a depth, with common-prefix lengths.

The sort works on bytes in three steps. Suffixes that are smaller than their follower but have a
larger one before them (the seeds, about a third) are sorted directly, eight bytes at a time, to the
depth. One pass over the buckets in rising order then induces the suffixes that are larger than
their follower; one in falling order induces the others. What a pass induces goes into queues, one
for each first byte, of tuples (position, common prefix with the queue's previous entry); queues
beyond a budget of memory go to files. The common prefix of two induced neighbours is one more than
the smallest one between their sources, so it is carried along and never compared again.

A difference to textbook form: as only a bounded depth is asked for, seeds need no recursion on a
reduced string; suffixes equal to the depth keep an arbitrary order and a common prefix of at least it.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

CAP = 200  # common prefixes are held in one byte
BUDGET = 64 << 20
BLOCK = 1 << 18  # entries of a queue that are handled together


class Queues:
    """256 first-in first-out queues of (positions, prefixes), on disk beyond ``budget`` bytes."""

    def __init__(self, budget: int = BUDGET):
        self.parts = [deque() for _ in range(256)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, bucket: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        size = positions.nbytes + prefixes.nbytes
        if self.held + size > self.budget:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(positions.tobytes())
            self.file.write(prefixes.tobytes())
            self.parts[bucket].append((at, len(positions)))
        else:
            self.held += size
            self.parts[bucket].append((positions, prefixes))

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next entries of a bucket, about ``BLOCK`` at most: few large steps cost less than many
        small ones, and the order is the same."""
        parts, size = [], 0
        while self.parts[bucket] and size < BLOCK:
            first, second = self.parts[bucket].popleft()
            if isinstance(first, int):
                self.file.seek(first)
                first, second = np.frombuffer(self.file.read(4 * second), dtype=np.int32), np.frombuffer(self.file.read(second), dtype=np.uint8)
            else:
                self.held -= first.nbytes + second.nbytes
            parts.append((first, second))
            size += len(first)
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the one that starts a byte later."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = (text[1:] > text[:-1]).view(np.int8) - (text[1:] < text[:-1]).view(np.int8)
    step[-1] = -1
    # Equal bytes take the answer of the next unequal place.
    place = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
    place[step == 0] = n
    turned = place[::-1]
    np.minimum.accumulate(turned, out=turned)
    return step[place] > 0


def sort_seeds(text: np.ndarray, seeds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``seeds`` in the order of their first ``depth`` bytes, and common prefixes of neighbours."""
    n = len(seeds)
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order, prefix = seeds.copy(), np.zeros(n, dtype=np.uint8)
    first = np.zeros(n, dtype=bool)  # starts of groups that are equal so far
    if n:
        first[0] = True
    active = np.arange(n)
    for at in range(0, depth, 8):
        if not len(active):
            break
        words = eight[order[active] + at].copy().view(">u8").ravel().astype(np.uint64)
        group = np.cumsum(first[active])
        rank = np.lexsort((words, group))
        order[active], words, group = order[active][rank], words[rank], group[rank]
        same = np.zeros(len(active), dtype=bool)
        same[1:] = group[1:] == group[:-1]
        unequal = np.zeros(len(active), dtype=np.uint64)
        unequal[1:] = words[1:] ^ words[:-1]
        split = same & (unequal != 0)
        leading = (unequal[split].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        prefix[active[split]] = at + leading
        prefix[active[same & ~split]] = min(CAP, at + 8)
        first[active[split]] = True
        # Only members of groups with more than one row go on.
        alone = first[active] & np.append(first[active][1:] | ~(np.diff(active) == 1), True)
        active = active[~alone]
    return order, prefix


class Ranges:
    """Minimum over ranges of one batch of common prefixes (a sparse table)."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over low..high, both included."""
        out = np.empty(len(low), dtype=np.uint8)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out


def induce(text: np.ndarray, small: np.ndarray, batches, queues: Queues, since: np.ndarray, rising: bool) -> None:
    """Puts what ``batches`` (positions, prefixes) induce into ``queues``.

    ``since`` holds, for each queue, the smallest prefix since the last entry it got.
    """
    for positions, prefixes in batches:
        has = positions > 0
        before = np.where(has, positions - 1, 0)
        wanted = has & (small[before] != rising)
        letters = text[before]
        index = np.flatnonzero(wanted)
        if not len(index):
            np.minimum(since, prefixes.min(), out=since)
            continue
        index = index[np.argsort(letters[index], kind="stable")]
        kinds = letters[index]
        ranges = Ranges(prefixes)
        starts = np.flatnonzero(np.diff(kinds.astype(np.int16), prepend=-1))
        low = np.empty(len(index), dtype=np.int64)
        low[1:] = index[:-1] + 1
        low[starts] = 0
        least = ranges.least(low, index)
        least[starts] = np.minimum(least[starts], since[kinds[starts]])
        np.minimum(since, prefixes.min(), out=since)
        for a, b in zip(starts, np.append(starts[1:], len(index))):
            letter = kinds[a]
            queues.push(int(letter), (positions[index[a:b]] - 1).astype(np.int32), np.minimum(least[a:b].astype(np.int16) + 1, CAP).astype(np.uint8))
            last = int(index[b - 1])
            since[letter] = ranges.least(np.array([last + 1]), np.array([len(prefixes) - 1]))[0] if last + 1 < len(prefixes) else 255


def sorted_suffixes(text: np.ndarray, depth: int, budget: int = BUDGET):
    """Yields (positions, common prefixes with the previous one) of all suffixes of ``text``, in order
    of their first ``depth`` bytes at least, bucket by bucket."""
    small = smaller_than_next(text)
    seed = np.zeros(len(text), dtype=bool)
    seed[1:] = small[1:] & ~small[:-1]
    seeds, seed_prefix = sort_seeds(text, np.flatnonzero(seed).astype(np.int32), depth + 8)
    cuts = np.searchsorted(text[seeds], np.arange(257))
    queues, larger = Queues(budget), Queues(budget)
    since = np.zeros(256, dtype=np.uint8)

    def led_by(prefixes: np.ndarray, first: int) -> np.ndarray:
        prefixes = prefixes.copy()
        prefixes[:1] = first
        return prefixes

    def shared_run(a: int, b: int) -> int:
        # A suffix larger than its follower and one that is smaller part where the run of c ends.
        return min(CAP, run_length(text, a), run_length(text, b))

    last = np.array([len(text) - 1], dtype=np.int32)
    queues.push(int(text[-1]), last, np.zeros(1, dtype=np.uint8))  # the last suffix has no follower
    for c in range(256):
        end = None
        while (part := queues.pop(c)) is not None:
            if end is None:
                part = part[0], led_by(part[1], 0)
            end = int(part[0][-1])
            larger.push(c, *part)
            induce(text, small, [part], queues, since, True)
        if cuts[c] < cuts[c + 1]:
            part = seeds[cuts[c] : cuts[c + 1]]
            part = part, led_by(seed_prefix[cuts[c] : cuts[c + 1]], 0 if end is None else shared_run(end, int(part[0])))
            induce(text, small, [part], queues, since, True)
    queues.close()

    # Falling order: prefixes are kept with the follower in that order, so arrays are turned round.
    found, since = [None] * 256, np.zeros(256, dtype=np.uint8)
    queues = Queues(budget)
    for c in range(255, -1, -1):
        smaller = []
        while (part := queues.pop(c)) is not None:
            if not smaller:
                part = part[0], led_by(part[1], 0)
            smaller.append(part)
            induce(text, small, [part], queues, since, False)
        bigger = []
        while (part := larger.pop(c)) is not None:
            bigger.append(part)
        if bigger:
            positions, prefixes = np.concatenate([p for p, _ in bigger]), np.concatenate([q for _, q in bigger])
            border = shared_run(int(positions[-1]), int(smaller[-1][0][-1])) if smaller else 0
            turned = np.append(np.uint8(border), prefixes[1:][::-1])
            induce(text, small, [(positions[::-1], turned)], queues, since, False)
            found[c] = [(positions, prefixes)]
        if smaller:
            positions, prefixes = np.concatenate([p for p, _ in smaller])[::-1], np.concatenate([q for _, q in smaller])
            # Turned back, each prefix belongs to the later of two neighbours.
            prefixes = np.append(np.uint8(border if bigger else 0), prefixes[1:][::-1])
            found[c] = (found[c] or []) + [(positions, prefixes)]
    queues.close()
    larger.close()
    for parts in found:
        yield from parts or []


def run_length(text: np.ndarray, at: int) -> int:
    """How often the byte at ``at`` is repeated from there on, to ``CAP`` at most."""
    stretch = text[at : at + CAP]
    other = np.flatnonzero(stretch != text[at])
    return int(other[0]) if len(other) else len(stretch)
