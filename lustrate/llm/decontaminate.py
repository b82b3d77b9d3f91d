"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages (``STEP`` words) of all documents.
2. A randomised SVD of TF-IDF passages, by subspace iteration over all documents and all of the
   benchmark, whose rows together weigh ``WEIGHT`` times the documents'. Each core reads its share of
   the rows and sends slices of A'(A Q), sums of ``BUCKETS x RANK`` numbers. One space serves all items.
3. Candidates by cosine. A copy must hold ``RARE`` of an item's rarest words (step 4), so inverted
   lists of these words pick the documents that do; this loses nothing that step 4 would confirm.
   Around each place where such a document holds one of the item's rare words, the window that lies
   as the item's own stretch lies around that word (``WIDTH`` words, or the whole of a shorter item)
   is projected and compared with that stretch by cosine (with the window's full norm, so what the
   space leaves out of a window counts as different, and in proportion to the share of the stretch's
   energy that the space holds). Items with a window from ``COSINE`` on are candidates.
4. A candidate is confirmed when ``RARE`` of the item's rarest words (``ANSWER`` of its given answer's
   words, where there is one) lie around the window, and the longest common subsequence of words covers
   ``COVER`` of the item, and ``LEAST`` words, within a stretch like the item's own. So changed or
   dropped words don't hide a copy, and common words alone don't make one.

Results for odd input: null and empty texts match nothing; items with a null text or fewer than
``SHORTEST`` words are never matched; very long texts are taken whole, one at a time; of equal covers
the one with more rare words, then with the higher cosine, is reported; rows that share a doc_id are
one document; repeated rows give one match; a null doc_id is carried as null; empty tables give no
rows; other columns are passed over.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lustrate.llm.hashing import arrow_parts, release, released, word_hashes

BUCKETS, RANK, WEIGHT, ROUNDS = 1 << 15, 128, 5.0, 2
STEP, WIDTH, COSINE, COVER, ANSWER, RARE, LEAST, SHORTEST = 12, 24, 0.3, 0.6, 0.6, 0.4, 5, 4
#: Numbers sent together, passages projected together, and places looked at together (these bound a
#: task's memory); words of the items that are sent to tasks and searched for in one pass.
SLICE, WINDOWS, PLACES, BLOCK_WORDS = 512, 2048, 1 << 18, 2_000_000
#: Buckets whose words the fit sums by matrix products; the others are gathered word by word.
HOT = 512
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def batch_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of the texts, punctuation aside, and where each text starts."""
    return word_hashes([(t or "").lower().encode("utf-8", "replace").translate(PLAIN) for t in texts])


def passages(starts: np.ndarray, step: int) -> np.ndarray:
    """Starts of the passages of ``step`` words within each text (none for an empty one)."""
    return np.concatenate([np.arange(a, b, step) for a, b in zip(starts[:-1], starts[1:])] + [np.zeros(0, dtype=np.int64)]).astype(np.int64)


def buckets(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(BUCKETS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each bucket occurs, and the number of passages, over all documents."""

    def count(batches):
        sums, total = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in arrow_parts(batches):
            words, starts = batch_words(batch.column("text").to_pylist())
            begins = passages(starts, STEP)
            # A row for each passage; within it, a bucket counts where it follows another one.
            cells = np.full((len(begins), STEP), BUCKETS, dtype=np.int32)
            place = np.zeros(len(words), dtype=np.int64)
            place[begins] = 1
            row = np.cumsum(place) - 1
            cells[row, np.arange(len(words)) - begins[row] if len(words) else row] = buckets(words)
            cells.sort(axis=1)
            new = np.ones(cells.shape, dtype=bool)
            new[:, 1:] = cells[:, 1:] != cells[:, :-1]
            sums += np.bincount(cells[new], minlength=BUCKETS + 1)
            total += len(begins)
        sums[BUCKETS] = total
        bucket = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(sums[bucket], pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS + 1, dtype=np.int64)
    counts[rows["bucket"]] = rows["n"]
    return counts[:-1], int(counts[-1])


def add_rows(out: np.ndarray, cells: np.ndarray, y: np.ndarray, of: np.ndarray) -> None:
    """``out[cells] += y[of]``, all of it where cells repeat: rows of one cell are added pair by pair."""
    order = np.argsort(cells, kind="stable")
    cells, sums = cells[order], y[of[order]]
    rows = np.arange(len(cells))
    while len(firsts := np.flatnonzero(np.diff(cells, prepend=-1))) < len(cells):
        odd = (np.arange(len(cells)) - np.repeat(firsts, np.diff(np.append(firsts, len(cells))))) & 1 == 1
        at = np.flatnonzero(odd)
        sums[rows[at - 1]] += sums[rows[at]]
        cells, rows = cells[~odd], rows[~odd]
    out[cells] += sums[rows]


def gram(rows: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'(A basis) for the TF-IDF passages A of ``rows`` (text, weight), summed over tasks slice by slice."""
    held = rows.sparkSession.sparkContext.broadcast((np.concatenate([basis * idf[:, None].astype(np.float32), np.zeros((1, basis.shape[1]), dtype=np.float32)]), idf))
    shape = basis.shape  # the tasks need no second copy of the basis

    def multiply(batches):
        weighted, idf = held.value
        hot, out, hot_sums = np.argsort(idf, kind="stable")[:HOT], np.zeros(shape), np.zeros((HOT, shape[1]))
        place = np.full(BUCKETS, -1)
        place[hot] = np.arange(HOT)
        for batch in arrow_parts(batches):
            words, starts = batch_words(batch.column("text").to_pylist())
            begins = passages(starts, WIDTH)
            weights = batch.column("weight").to_numpy()[np.searchsorted(starts, begins, side="right") - 1]
            for low in range(0, len(begins), WINDOWS):
                some, heavy = begins[low : low + WINDOWS], weights[low : low + WINDOWS]
                end = begins[low + len(some)] if low + len(some) < len(begins) else len(words)
                cells, cuts = buckets(words[some[0] : end]), some - some[0]
                of = np.repeat(np.arange(len(some)), np.diff(np.append(cuts, len(cells))))
                norms = np.sqrt(np.maximum(np.bincount(of, weights=idf[cells] ** 2), 1e-9))
                # The most frequent buckets, which most words fall into, are summed by products of counts.
                at = place[cells]
                frequent = at >= 0
                table = np.bincount(of[frequent] * HOT + at[frequent], minlength=len(some) * HOT).astype(np.float32).reshape(len(some), HOT)
                y = table @ weighted[hot]
                # Of the other words, the k-th ones of the passages that have so many are gathered together.
                cells, of = cells[~frequent], of[~frequent]
                sizes = np.bincount(of, minlength=len(some))
                order, firsts = np.argsort(-sizes, kind="stable"), np.cumsum(sizes) - sizes
                rest = np.zeros_like(y)
                for k in range(int(sizes.max())):
                    longer = order[: int((sizes > k).sum())]
                    rest[: len(longer)] += weighted[cells[firsts[longer] + k]]
                y[order] += rest
                y *= (heavy / norms**2)[:, None].astype(np.float32)
                hot_sums += table.T @ y
                add_rows(out, cells, y, of)
        out[hot] += hot_sums
        out *= idf[:, None]
        data = [out[i : i + SLICE].astype(np.float32).tobytes() for i in range(0, BUCKETS, SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(0, BUCKETS, SLICE), pa.int32()), pa.array(data, pa.binary())], ["slice", "data"])

    def add(group):
        total = reduce(np.add, (np.frombuffer(x, dtype=np.float32) for x in group["data"]))
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "data": [total.tobytes()]})

    # Each task sends BUCKETS x RANK numbers, so there is one for each core, whatever the number of files.
    few = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    parts = few.mapInArrow(released(multiply), "slice int, data binary").groupBy("slice").applyInPandas(add, "slice int, data binary")
    out = np.zeros(shape, dtype=np.float32)
    for at, data in parts.toLocalIterator():
        out[at : at + SLICE] = np.frombuffer(data, dtype=np.float32).reshape(-1, shape[1])
    held.destroy()
    return out


def orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``y``, in its place: directions that ``y`` lacks become zeros.

    From the small matrix Y'Y in double precision, so the driver holds ``y`` and one slice besides."""
    inner = np.zeros((y.shape[1], y.shape[1]))
    for at in range(0, len(y), SLICE):
        part = y[at : at + SLICE].astype(np.float64)
        inner += part.T @ part
    values, turn = np.linalg.eigh(inner)
    turn = turn * np.where(values > values[-1] * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    for at in range(0, len(y), SLICE):
        y[at : at + SLICE] = y[at : at + SLICE].astype(np.float64) @ turn
    return y


def latent_space(docs: DataFrame, items: DataFrame, idf: np.ndarray, passages_in_all: int) -> np.ndarray:
    """Word vectors (idf times the right singular vectors) of the passages' TF-IDF matrix, over all rows."""
    weight = WEIGHT * max(1.0, passages_in_all / 2) / max(1, items.count())
    rows = docs.select("text", F.lit(1.0).alias("weight")).unionByName(items.select("text", F.lit(weight).alias("weight")))
    # Single precision halves the driver's memory and is ample for these vectors.
    basis = orthonormal(np.random.default_rng(11).standard_normal((BUCKETS, RANK), dtype=np.float32))
    for _ in range(ROUNDS):
        basis = orthonormal(gram(rows, basis, idf))
        release()
    basis *= idf[:, None].astype(np.float32)
    return basis


class Item:
    """A benchmark item ready for the check of its words."""

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray, idf: np.ndarray, answer_share: float = ANSWER):
        self.id, self.words = item_id, words
        self.bits: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.bits[w] = self.bits.get(w, 0) | 1 << i
        rare = np.unique(words)
        rare = rare[np.argsort(-idf[buckets(rare)], kind="stable")][: max(1, len(rare) // 3)]
        self.rare = frozenset((np.unique(answer) if len(answer) else rare).tolist())
        #: How many of these words a copy holds at the least.
        self.needed = (answer_share if len(answer) else RARE) * len(self.rare) - 1e-9
        #: Words around whose places windows are compared.
        self.anchors = self.rare.union(rare.tolist())

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence, bit-parallel over the item's words."""
        row = full = (1 << len(self.words)) - 1
        for w in words:
            hit = row & self.bits.get(w, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        return len(self.words) - row.bit_count()

    def check(self, words: list[int], cover: float) -> tuple[float, float]:
        """Best share of the item in a stretch about as long as the item with enough of its rare words, and
        their share there; nothing below ``cover``, or of fewer than ``LEAST`` words."""
        n, best = len(self.words), (0.0, 0.0)
        span, least = n + n // 4 + 2, max(cover * n, min(LEAST, n))
        for at in range(0, max(1, len(words) - n), max(1, n // 4)):
            part = words[at : at + span]
            # The cheap check first: without the rare words there is no need to align.
            rare = len(self.rare.intersection(part))
            if rare >= self.needed and (common := self.common(part)) >= least:
                best = max(best, (common / n, rare / len(self.rare)))
        return best


class Lists:
    """Inverted lists over items: from rare words to the items that need them, and from anchors to
    their places in the items."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.sizes = np.array([len(x.words) for x in items], dtype=np.int64)
        self.text = np.concatenate([np.zeros(0, dtype=np.uint64), *(x.words for x in items)])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.needed = np.array([x.needed for x in items])
        need = [(w, k) for k, x in enumerate(items) for w in x.rare]
        places = [(w, k, q) for k, x in enumerate(items) for q, w in enumerate(x.words.tolist()) if w in x.anchors]
        self.words = np.unique(np.array([r[0] for r in need + places], dtype=np.uint64))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.words & np.uint64((1 << 20) - 1)] = True
        self.need, self.need_starts = self._grouped(need)
        self.places, self.place_starts = self._grouped(places)

    def _grouped(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.words, np.array([r[0] for r in rows], dtype=np.uint64))
        order = np.argsort(at, kind="stable")
        rest = np.array([r[1:] for r in rows], dtype=np.int64)[order]
        return rest, np.searchsorted(at[order], np.arange(len(self.words) + 1))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of listed words, and which ones they are."""
        pos = np.flatnonzero(self.maybe[words & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.words, words[pos]), len(self.words) - 1)
        there = self.words[at] == words[pos]
        return pos[there], at[there]


def entries_of(at: np.ndarray, starts: np.ndarray, table: np.ndarray):
    """For the lists ``at``: (which element of ``at``, row of the list), in blocks of bounded size."""
    sizes = starts[at + 1] - starts[at]
    ends, low = np.cumsum(sizes), 0
    while low < len(at):
        # At least one list; its length is bounded by the items that are searched for together.
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PLACES, side="right")))
        some = sizes[low:high]
        of = np.repeat(np.arange(low, high), some)
        yield of, table[np.arange(int(some.sum())) + np.repeat(starts[at[low:high]] - (np.cumsum(some) - some), some)]
        low = high


def holders(lists: Lists, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted keys (document times items plus item) of the documents that hold enough of an item's
    rare words, given their listed words."""
    width, kept = len(lists.items), [np.zeros(0, dtype=np.int64)]
    seen = np.unique(doc * len(lists.words) + at)
    doc, at = seen // len(lists.words), seen % len(lists.words)
    # Whole documents together, so that all words of one are counted at once.
    sizes = np.cumsum(lists.need_starts[at + 1] - lists.need_starts[at])
    cuts, low = [*np.flatnonzero(np.diff(doc)) + 1, len(doc)], 0
    for k, high in enumerate(cuts):
        if k + 1 < len(cuts) and sizes[cuts[k + 1] - 1] - (sizes[low - 1] if low else 0) <= PLACES:
            continue
        keys = [doc[low:high][of] * width + rows[:, 0] for of, rows in entries_of(at[low:high], lists.need_starts, lists.need)]
        if keys:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            kept.append(key[n >= lists.needed[key % width]])
        low = high
    return np.concatenate(kept)


def alike(lists: Lists, vectors: np.ndarray, squares: np.ndarray, words: np.ndarray, starts: np.ndarray, doc: np.ndarray, pos: np.ndarray, item: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of the window around each place ``pos`` with the stretch around the item's word ``q``,
    and where the window starts."""
    n = lists.sizes[item]
    width = np.minimum(WIDTH, n)
    first = np.clip(q - WIDTH // 2, 0, n - width)
    low = np.maximum(pos - (q - first), starts[doc])
    high = np.maximum(np.minimum(low + width, starts[doc + 1]), pos + 1)

    def project(text, begins, sizes):
        cells = buckets(text[np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)])
        cuts = np.cumsum(sizes) - sizes
        norm = np.sqrt(np.maximum(np.add.reduceat(squares[cells], cuts), 1e-6))
        return np.add.reduceat(vectors[cells], cuts, axis=0) / norm[:, None]

    ours, theirs = project(words, low, high - low), project(lists.text, lists.begins[item] + first, width)
    return (ours * theirs).sum(axis=1) / np.maximum((theirs**2).sum(axis=1), 0.05), low


def around(places: dict[int, float], n: int):
    """(low, high, best cosine) of the text within an item's ``n`` words of the windows at ``places``,
    together where they overlap, so that no text is aligned twice."""
    low = high = near = None
    for at in sorted(places):
        if high is not None and at - n <= high:
            high, near = at + WIDTH + n, max(near, places[at])
            continue
        if high is not None:
            yield low, high, near
        low, high, near = at - n, at + WIDTH + n, places[at]
    if high is not None:
        yield low, high, near


def find_leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE, cover: float = COVER, answer_share: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, cosine, cover, answer): the items found in each document, once each.

    ``items`` has item_id, text and, if known, answer.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    # What earlier work left on the driver, in Python and in the JVM, goes before this needs its matrices.
    release()
    spark._jvm.System.gc()
    counts, total = document_frequencies(docs)
    idf = np.log1p(total / (1 + counts))
    answers = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text", answers.alias("answer")).where("text IS NOT NULL AND item_id IS NOT NULL")
    vectors = latent_space(docs, given, idf, total)
    # Of a fixed size: BUCKETS x RANK numbers.
    held = spark.sparkContext.broadcast((vectors, idf))
    del vectors
    release()
    fields = [StructField("item_id", LongType()), *(StructField(c, DoubleType()) for c in ("cosine", "cover", "answer"))]
    schema = StructType([docs.schema["doc_id"], *fields])

    def search(block: list) -> DataFrame:
        # Of at most BLOCK_WORDS words, or one item.
        sent = spark.sparkContext.broadcast([tuple(r) for r in block])

        def run(batches):
            vectors, idf = held.value
            squares = (idf**2).astype(np.float32)
            words, starts = batch_words([x[1] for x in sent.value])
            answer, at = batch_words([x[2] for x in sent.value])
            items = [Item(x[0], words[starts[i] : starts[i + 1]], answer[at[i] : at[i + 1]], idf, answer_share) for i, x in enumerate(sent.value) if starts[i + 1] - starts[i] >= SHORTEST]
            if not items:
                return
            lists = Lists(items)
            for batch in arrow_parts(batches):
                words, starts = batch_words(batch.column("text").to_pylist())
                pos, at = lists.hits(words)
                doc, found = np.searchsorted(starts, pos, side="right") - 1, {}
                keys = holders(lists, doc, at)
                some = np.isin(doc, keys // len(items))
                pos, at, doc = pos[some], at[some], doc[some]
                for of, rows in entries_of(at, lists.place_starts, lists.places) if len(keys) else ():
                    key = doc[of] * len(items) + rows[:, 0]
                    of, rows = (x[keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key] for x in (of, rows))
                    for low in range(0, len(of), WINDOWS):
                        o, r = of[low : low + WINDOWS], rows[low : low + WINDOWS]
                        near, begin = alike(lists, vectors, squares, words, starts, doc[o], pos[o], r[:, 0], r[:, 1])
                        good = near >= cosine
                        for d, k, b, value in zip(doc[o][good].tolist(), r[good, 0].tolist(), begin[good].tolist(), near[good].tolist()):
                            places = found.setdefault((d, k), {})
                            places[b] = max(value, places.get(b, 0.0))
                out = []
                for (d, k), places in found.items():
                    item, best = items[k], (0.0, 0.0, 0.0)
                    for low, high, near in around(places, len(item.words)):
                        share, rare = item.check(words[max(int(starts[d]), low) : min(int(starts[d + 1]), high)].tolist(), cover)
                        if share:
                            best = max(best, (share, rare, near))
                    if best[0]:
                        out.append((d, item.id, best[2], best[0], best[1]))
                if out:
                    which, ids, *rest = zip(*out)
                    columns = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(ids, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        return docs.mapInArrow(released(run), schema)

    blocks, block, size = [], [], 0
    for row in given.toLocalIterator():
        block.append(row)
        size += row["text"].count(" ") + 1
        if size > BLOCK_WORDS:
            blocks.append(search(block))
            block, size = [], 0
    if block or not blocks:
        blocks.append(search(block))
    return reduce(DataFrame.unionByName, blocks).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "cover", "answer")])


def op4_latent_decontamination(spark, sf_dir):
    """The benchmark items that each document holds, copied or paraphrased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
