"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with equal sets form a class,
   found by partial aggregation; only one text of each class goes on, so copies never make pairs.
2. The sketch of a text is the ``SKETCH`` smallest hashes of its set. The ``LISTED`` smallest are
   entered in inverted lists. Two texts at the threshold share at least ``SHARED`` of these (it fails
   with a chance under 1e-6 for each pair at the very threshold), so each text may leave its
   ``SHARED - 1`` most frequent values out of the lists (prefix filtering): shingles of lines that
   many texts hold make few candidates.
3. Hub round: in each list, texts are paired with its smallest id. Pairs whose overlap in the sketch
   of their union lies ``SPREAD`` standard deviations under the threshold go (a draw without
   replacement, so a sketch that holds the whole union decides exactly); the others are compared by
   their full sets. Verified links give components by alternating large-star and small-star steps.
4. Rest rounds: the texts in lists that still hold several components enter lists by their whole
   sets, without the most frequent four fifths of each (exact prefix filtering: a linked pair must
   meet in the rest). First, a few random hubs of each list are paired with the texts of other
   components, ``ROUNDS`` times: this joins loose groups, whose texts differ too much from any single
   hub, at a few pairs a text. Then the members of each list meet: those stay that have a member of
   another component with enough values after the list's in both for the overlap that their sizes ask
   for (positional filtering), and the sets of these are compared all at once, by the counts of the
   values that they share. No pair is a row: a list gives back at most a link for each member. Lists
   longer than ``BLOCK``, or of more than ``VALUES`` values, meet block by block.

Results for odd input: a null or empty text, or one of white space only, has an empty set and is
linked with nothing; very long texts are hashed in buffers, a text at a time; rows with one doc_id
count as one document, which is linked with whatever any of its texts is linked with; a row with a null id is
compared like others when a copy has an id, and else stays alone with a null component; repeated rows fall
into one class; other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lustrate.llm.hashing import arrow_parts, mix, released, shingle_sets
from lustrate.scratch import Scratch, small

#: Sketch size, values entered in lists, values that similar texts share, and the sketch's leeway.
SKETCH, LISTED, SHARED, SPREAD = 128, 32, 13, 6.0
#: Rounds of random hubs, hubs of a list in each, and lists of a text that take part.
ROUNDS, HUBS, LISTS = 3, 8, 4
NEEDED_BYTES = 16 << 20
#: Partners of a text that are compared with it in one task; members of a list that meet there, and values of
#: their sets, about.
GROUP, BLOCK, VALUES = 4096, 1024, 1 << 19
#: Holders up to which a value's pairs are counted one by one, and cells of the products that count the others.
FEW, CELLS = 16, 1 << 22


def encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def lists_of(sets: list[np.ndarray]) -> pa.ListArray:
    """Sets of hashes as an Arrow column of signed numbers."""
    values = np.concatenate([np.zeros(0, dtype=np.int64), *(s.view(np.int64) for s in sets)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(values))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hash (of the text), n (set size), key1 and key2 (of the whole set), sketch of every row."""

    def run(batches):
        for batch in arrow_parts(batches):
            sets = shingle_sets(encoded(batch.column("text")), width)
            keys = [pa.array([int(mix(s + np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64()) for c in (1, 2)]
            sketch = lists_of([np.sort(s[:SKETCH].view(np.int64)) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array([len(s) for s in sets], pa.int64()), *keys, sketch], ["doc_id", "hash", "n", "key1", "key2", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(released(run), "doc_id long, hash long, n long, key1 long, key2 long, sketch array<long>")


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, comp) of the nodes in ``links`` (a, b): comp is the smallest node reachable."""
    edges, step = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}0"), 0
    while True:
        # Large star: a node's larger neighbours (and itself) go to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct(), f"{label}{step}l")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        after = scratch.save(small_star.where("a <> b").distinct(), f"{label}{step + 1}")
        # Done when every node has one edge, to a node that has no smaller one.
        many = after.groupBy("a").count().where("count > 1").limit(1)
        chained = after.select(F.col("b").alias("x")).distinct().join(after.select(F.col("a").alias("x")), "x", "left_semi").limit(1)
        scratch.drop(f"{label}{step}", f"{label}{step}l")
        if not many.head(1) and not chained.head(1):
            return after.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        edges, step = after, step + 1


def likely(pairs: DataFrame, nodes: DataFrame, num: int, den: int, spread: float | None) -> DataFrame:
    """The pairs (a, b) whose sizes and union sketch allow the similarity num / den, within ``spread``
    standard deviations of the estimate (None: whose sizes allow it)."""
    if spread is None:
        n = nodes.select("node", "n")
        sized = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
        return sized.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u"))
    sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    at, seen = num / den, F.size("u")
    # The union's size at the threshold; more similar texts have a smaller union.
    whole = (F.col("na") + F.col("nb")) * den / (num + den)
    leeway = spread * F.sqrt(F.greatest(F.lit(0.0), 1 - seen / whole) * (at * (1 - at)) / seen) + 1e-9
    return joined.where(sizes).withColumn("u", union).where(shared >= seen * (at - leeway)).select("a", "b")


def texts_of(docs: DataFrame, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``ids`` (a saved table of node and others, which are kept); ``reps``
    (a saved table of node, doc_id and hash) tells which document and which of its texts stands for each."""
    asked = small_join(ids, reps)
    held = docs.withColumn("_hash", F.xxhash64("text")).join(asked.withColumnsRenamed({"doc_id": "_id", "hash": "_of"}), (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_of")))
    return held.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def small_join(ids: DataFrame, reps: DataFrame) -> DataFrame:
    """``ids`` with their document and hash, to be broadcast if they are few."""
    few = ids.count() * 56 <= NEEDED_BYTES
    joined = reps.join(F.broadcast(ids) if few else ids, "node")
    return F.broadcast(joined) if few else joined


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, scratch: Scratch, label: str, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose full shingle sets have a Jaccard similarity of num / den or more.

    Pairs are grouped by their second text, at most about ``GROUP`` together, so a text with many
    partners is sent once for each group and its set is made once; the partners stream past it."""
    needed = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{label}-needed")
    texts = scratch.save(texts_of(docs, needed, reps), f"{label}-texts")
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("part"))
    dealt = scratch.save(dealt, f"{label}-dealt")
    side = lambda x: texts.select(F.col("node").alias(x), "text")
    heads = dealt.select("b", "part").distinct().join(side("b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    both = heads.unionByName(dealt.join(side("a"), "a").select("b", "part", "a", "text"))
    # A head sorts before the partners of its group.
    both = both.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(batches):
        head = np.zeros(0, dtype=np.uint64)
        for batch in arrow_parts(batches):
            a, b, linked = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, own in enumerate(shingle_sets(encoded(batch.column("text")), width)):
                if a[i] is None:
                    head = own
                    continue
                shared = len(np.intersect1d(head, own, assume_unique=True))
                if den * shared >= num * (len(head) + len(own) - shared):
                    linked.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in linked], pa.int64()) for x in (a, b)], ["a", "b"])

    return scratch.save(both.mapInArrow(released(compare), "a long, b long"), label)


def whole_sets(docs: DataFrame, nodes: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(node, n, value): all shingles of the texts of ``nodes`` (node, n; a saved table)."""

    def run(batches):
        for batch in arrow_parts(batches):
            sets = lists_of(shingle_sets(encoded(batch.column("text")), width))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), sets], ["node", "n", "values"])

    return texts_of(docs, nodes, reps).select("node", "n", "text").mapInArrow(released(run), "node long, n long, values array<long>").select("node", "n", F.explode("values").alias("value"))


def between(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """``entries`` with their component, in lists that hold more than one component, and the number of
    ``blocks`` into which such a list falls."""
    placed = entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / VALUES))
    mixed = placed.groupBy("value").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), blocks.alias("blocks"))
    return placed.join(mixed.where("x <> y").select("value", "blocks"), "value")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of ``sets`` (of distinct values) share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    firsts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    holders = np.diff(np.append(firsts, len(values)))
    counts, many = np.zeros(m * m, dtype=np.float32), np.repeat(holders > FEW, holders)
    v, o = values[~many], owner[~many]
    for step in range(1, min(FEW, int(holders.max(initial=1)))):
        same = np.flatnonzero(v[step:] == v[:-step])
        if not len(same):
            break
        counts += np.bincount(o[same] * m + o[same + step], minlength=m * m)
    counts = counts.reshape(m, m)
    counts += counts.T
    # Values with many holders: products of tables of members by values, some columns at a time.
    column, o, width = np.repeat(np.arange(int((holders > FEW).sum())), holders[holders > FEW]), owner[many], max(1, CELLS // m)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        table = np.zeros((m, width), dtype=np.float32)
        table[o[a:b], column[a:b] - low] = 1
        counts += table @ table.T
    return counts


def joined(node: np.ndarray, comp: np.ndarray, n: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of members of one list: one for each component that goes to another."""
    shared = shared_counts(sets).astype(np.int64)
    linked = den * shared >= num * (n[:, None] + n - shared)
    comps, of = np.unique(comp, return_inverse=True)
    first, second = np.nonzero(np.triu(linked & (of[:, None] != of)))
    label = np.arange(len(comps))
    while True:
        x, y = label[of[first]], label[of[second]]
        if np.array_equal(x, y):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
    stands = node[np.unique(of, return_index=True)[1]]
    moved = np.flatnonzero(label != np.arange(len(comps)))
    return stands[moved], stands[label[moved]]


PLACE = ["value", "low", "high"]


def places(batches):
    """(rows, where places start and end) of batches of rows in order of their ``PLACE``; no place is cut, and
    only the last one of a batch, which may go on in the next, is held back."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in PLACE], axis=1)
        starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in PLACE):
            starts = np.concatenate([[0], starts])
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        yield from cut_places([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    yield from cut_places(held)


def cut_places(rows: list[pa.RecordBatch]):
    if rows := [x for x in rows if x.num_rows]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        keys = np.stack([whole.column(c).to_numpy() for c in PLACE], axis=1)
        yield whole, np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])


def partnered(starts: np.ndarray, comp: np.ndarray, n: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which members of places have a partner of another component there that sizes and ranks allow."""
    some, room = np.zeros(len(comp), dtype=bool), np.repeat(starts[1:], np.diff(starts)) - np.arange(len(comp))
    a, step = np.flatnonzero(room > 1), 1
    while len(a):
        b = a + step
        # At the first value that two texts share, what follows in both bounds the size of their intersection.
        bound = np.minimum(n[a] - rank[a], n[b] - rank[b]) + 1
        fits = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num) & (bound * (num + den) >= (n[a] + n[b]) * num)
        some[a[fits]] = some[b[fits]] = True
        step += 1
        a = a[room[a] > step]
    return some


def met(rest: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components of ``rest`` (value, blocks, node, n, rank, comp), the members of
    lists; ``sets`` has the values of each node that another node holds too."""
    # A long list falls into blocks by a hash; each two blocks meet in a place of their own, so the
    # members of a place are bounded whatever a list's length.
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"))))
    members = rest.withColumn("at", meets).select("value", "at.low", "at.high", "node", "comp", "n", "rank").repartition(*PLACE).sortWithinPartitions(*PLACE)
    names = [*PLACE, "node", "comp", "n"]

    def sift(batches):
        for rows, starts in places(batches):
            keep = partnered(starts, *(rows.column(c).to_numpy() for c in ("comp", "n", "rank")), num, den)
            yield from rows.select(names).filter(pa.array(keep)).to_batches()

    def compare(batches):
        for rows, starts in places(batches):
            node, comp, n = (rows.column(c).to_numpy() for c in ("node", "comp", "n"))
            values, links = rows.column("values").combine_chunks(), []
            ends, flat = values.offsets.to_numpy(), values.values.to_numpy()
            for low, high in zip(starts[:-1], starts[1:]):
                sets = [flat[ends[i] : ends[i + 1]] for i in range(low, high)]
                links.append(joined(node[low:high], comp[low:high], n[low:high], sets, num, den))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*links)], ["a", "b"])

    left = members.mapInArrow(sift, ", ".join(f"{c} long" for c in names)).join(sets, "node").select(*names, "values")
    return left.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(released(compare), "a long, b long").distinct()


def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs that were not compared before, in either order."""
    turned = tried.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(tried.unionByName(turned), ["a", "b"], "left_anti")


def grown(comps: DataFrame, links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Components after more links."""
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links), scratch, label)


def near_groups(docs: DataFrame, width: int = 4, num: int = 80, den: int = 100, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    By default a linked pair of texts with more than ``LISTED`` shingles is missed with a chance of
    about 1e-6 (it must share fewer than ``SHARED`` of its listed values, or lie ``SPREAD`` deviations
    under the threshold in the union's sketch), unless others link its ends. ``exact`` rules that out:
    all texts enter the rest rounds by their whole sets, and nothing is filtered by an estimate."""
    spread = None if exact else SPREAD
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark, "near")
    rows = scratch.save(sketches(docs, width), "rows")
    keys = ["key1", "key2", "n"]
    # A class is a node of its own; one of its documents, and one of that document's texts, stand for it.
    stands = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))).alias("first")
    classes = rows.where("n > 0").groupBy(*keys).agg(stands).where("first IS NOT NULL").select(*keys, "first.doc_id", "first.hash")
    # Nodes are numbered in the order of their ids: the first text of a group, of which the others are
    # often copies, is the hub of most of its lists.
    parts = spark.sparkContext.defaultParallelism
    classes = classes.repartitionByRange(parts, "doc_id", *keys).sortWithinPartitions("doc_id", *keys)
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = classes.select("node", "doc_id", "hash")
    nodes = rows.where("n > 0").join(classes, [*keys, "doc_id", "hash"])
    nodes = scratch.save(nodes.groupBy("node").agg(F.min(F.struct("n", "sketch")).alias("first")).select("node", "first.n", "first.sketch"), "nodes")

    entries = nodes.select("node", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    frequent = entries.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1")
    shared = entries.join(frequent, "value")
    # Values of one text only come first in the order of frequency and need no place in a list.
    of_node = Window.partitionBy("node")
    size = F.least(F.col("n"), F.lit(LISTED))
    least_shared = F.least(F.lit(SHARED), F.ceil(size * num / den))
    ranked = shared.withColumn("rank", F.row_number().over(of_node.orderBy("lists", "value")) + size - F.count("*").over(of_node))
    kept = scratch.save(ranked.where(F.col("rank") <= size - least_shared + 1).select("node", "n", "value"), "entries")

    hubs = kept.groupBy("value").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    first = kept.join(hubs, "value").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = scratch.save(likely(first, nodes, num, den, spread), "first")
    links = verified(first, docs, reps, scratch, "links", width, num, den)
    comps = components(links, scratch, "comps")

    open_nodes = nodes.select("node", "n") if exact else between(kept, comps).groupBy("node").agg(F.first("n").alias("n"))
    open_nodes = scratch.save(open_nodes, "open")
    full = whole_sets(docs, open_nodes, reps, width)
    frequent = full.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1")
    shared = scratch.save(full.join(frequent, "value"), "shared-values")
    sets = scratch.save(shared.groupBy("node").agg(F.collect_list("value").alias("values")), "sets")
    ranked = shared.withColumn("rank", F.row_number().over(of_node.orderBy("lists", "value")) + F.col("n") - F.count("*").over(of_node))
    last = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    prefix = scratch.save(ranked.where(F.col("rank") <= last).select("value", "node", "n", "rank", (F.col("rank") > last - LISTS).alias("late")), "prefix")
    sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    tried = first
    for turn in range(ROUNDS):
        entries = between(prefix.where("late"), comps)
        chosen = entries.groupBy("value").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64(F.lit(turn * HUBS + i), "node").alias("h"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))) for i in range(HUBS)])).alias("hubs"))
        chosen = chosen.select("value", F.explode("hubs").alias("u")).select("value", "u.b", "u.n_b", "u.comp_b").distinct()
        pairs = entries.select("value", F.col("node").alias("a"), F.col("n").alias("n_a"), "comp").join(chosen, "value").where((F.col("comp") != F.col("comp_b")) & sizes).select("a", "b").distinct()
        pairs = scratch.save(likely(untried(pairs, tried), nodes, num, den, spread), f"hubs{turn}")
        if not pairs.head(1):
            break
        tried = scratch.save(tried.unionByName(pairs), f"tried{turn}")
        comps = grown(comps, verified(pairs, docs, reps, scratch, f"found{turn}", width, num, den), scratch, f"comps{turn}")

    rest = scratch.save(between(prefix, comps), "rest-lists")
    links = scratch.save(met(rest, sets, num, den), "more")
    if links.head(1):
        comps = grown(comps, links, scratch, "all")

    # Rows that share an id are one document, so the classes that they fall into are linked by it.
    several = rows.where("n > 0").groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("k"), F.max(F.struct(*keys)).alias("l")).where("doc_id IS NOT NULL AND k <> l")
    several = scratch.save(several.select("doc_id"), "several")
    if several.head(1):
        held = rows.select("doc_id", *keys).join(several, "doc_id").join(classes.select(*keys, "node"), keys).select("doc_id", "node").distinct()
        of_doc = held.groupBy("doc_id").agg(F.min("node").alias("b"))
        comps = grown(comps, held.join(of_doc, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b"), scratch, "shared")
    of_class = scratch.save(classes.join(comps, "node", "left").select(*keys, "doc_id", F.coalesce("comp", "node").alias("comp")), "of_class")
    smallest = of_class.groupBy("comp").agg(F.min("doc_id").alias("component"))
    of_class = scratch.save(of_class.join(smallest, "comp").select(*keys, "component"), "components")
    out = rows.select("doc_id", *keys).join(of_class, keys, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    scratch.drop("nodes", "entries", "open", "prefix", "first", "shared-values", "sets", "rest-lists", *[f"{x}{i}" for i in range(ROUNDS) for x in ("hubs", "tried")])
    scratch.drop(*[f"{x}{y}" for x in ("links", *(f"found{i}" for i in range(ROUNDS))) for y in ("", "-needed", "-texts", "-dealt")], "more")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9_bottomk_near_dedup(spark, sf_dir):
    """Components of documents that share four fifths of their four-word shingles."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
