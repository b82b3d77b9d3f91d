"""The training-data operators against brute force, round trips and chosen odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lustrate.llm import bpe, decontaminate, exact_dedup, induced_sort, language_id, near_dedup, quality, queries, sharding, suffix_dedup, url_filter, warc
from lustrate.llm.hashing import shingle_sets
from lustrate.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, _group string"


@pytest.fixture(scope="module")
def bpe_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts, parts=3):
    """Rows with odd and clashing extra columns; ids are places."""
    return spark.createDataFrame([(i, t, "en", "src0", 0, "x", 0.5, "g") for i, t in enumerate(texts)], DOCS).repartition(parts)


ODD = ["", None, " \t\n", "A", "a", "same text here", "same text here", "Same Text Here", "é" * 5, "x" * 200_000, "ab " * 3000, "it's 12 o'clock\r\n　ok <|endoftext|> z"]


def operators(spark, bpe_file):
    """Each operator as a function of documents, as simple as its parameters allow."""
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")

    def archived(d):
        scratch = Scratch(spark, "t")
        warc.write_archives(d.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html")), scratch.path("w"), "<urn:uuid:t>", scratch)
        return warc.read_archives(spark, scratch.path("w"), "<urn:uuid:t>")

    return {
        1: lambda d: sharding.shard_rows(d.select("doc_id", "text"), 3, ["doc_id", "text"]),
        2: suffix_dedup.remove_repeats,
        3: lambda d: quality.score_quality(d, labels),
        4: lambda d: decontaminate.find_leaks(d, items),
        5: archived,
        6: lambda d: bpe.encode(d, bpe_file),
        7: lambda d: url_filter.judge_urls(d.withColumn("url", F.lit("http://a.net/")), url_filter.SITE_RULES),
        8: lambda d: language_id.identify(d, language_id.default_vocabulary()),
        9: near_dedup.near_groups,
        10: exact_dedup.exact_dedup,
    }


@pytest.mark.parametrize("number", range(1, 11))
def test_tables_without_rows_and_splits_without_rows(spark, bpe_file, number):
    # Read from files: the optimiser would turn where("false") into a plan that runs nothing.
    scratch, operator = Scratch(spark, "odd"), operators(spark, bpe_file)[number]
    empty = scratch.save(docs(spark, ["x"]).where("doc_id < 0"), "empty")
    assert empty.rdd.getNumPartitions() > 0 and operator(empty).count() == 0
    few = docs(spark, ["one two three four five six", "one two three four five six", None], parts=1).repartition(7, "text")
    assert len([n for n in few.rdd.glom().map(len).collect() if n == 0]) >= 5
    assert operator(few).count() == {4: 2, 7: 1}.get(number, 3)


@pytest.mark.parametrize("name", ["op5_warc_revisits", "op7_url_rules", "op10_radix_dedup"])
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(tuple(dict(zip(rel.columns, r))[c] for c in names) for r in rel.fetchall())


# ---- 1 sharding


def test_sharding_query_reports_whole_texts(spark, sf_dir):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    got = sharding.op1_hypergeometric_shards(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.slot)
    assert set(held) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in held.values())
    counts = [len(held.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1


def test_shards_are_even_and_slots_gapless(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("slot"))
    out = sharding.shard_rows(rows, 7, ["doc_id"], block_rows=50).toPandas()
    sizes = out["shard"].value_counts()
    assert sizes.max() - sizes.min() <= 1 and len(out) == 1000 and out["doc_id"].is_unique
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    again = sharding.shard_rows(rows.repartition(9), 7, ["doc_id"], block_rows=50).toPandas()
    assert dict(zip(out.doc_id, zip(out.shard, out.slot))) == dict(zip(again.doc_id, zip(again.shard, again.slot)))


def test_shards_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (5, 2), (5, 2), (None, None)], "doc_id long, n long")
    out = sharding.shard_rows(rows, 3, ["doc_id", "n"]).toPandas()
    assert sorted(out["shard"].value_counts()) == [1, 2, 2]
    assert sharding.shard_rows(rows.where("false"), 3, ["doc_id"]).count() == 0


def test_matrix_has_the_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = np.array([sharding.draw_matrix(rng, [30, 70], [50, 50])[0][0] for _ in range(3000)])
    assert abs(draws.mean() - 15) < 0.2 and abs(draws.var() - 30 * 0.25 * 70 / 99) < 0.5
    big = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 250_000) < 200


# ---- 10 exact dedup


def test_exact_groups(spark):
    texts = ODD + ["p" * 5000 + c for c in "abA"] + ["q" * 64, "q" * 64, "q" * 65]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    groups = {t: [i for i, x in enumerate(low) if x == t] for t in low}
    for i, t in enumerate(low):
        want = (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want


def test_exact_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "z"), (None, "z")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect())
    assert got == {(None, 3, 3, False): 1, (3, 3, 3, True): 2, (None, None, 2, True): 2}
    assert exact_dedup.exact_dedup(rows.where("false")).count() == 0


# ---- 2 suffix dedup


def brute_repeats(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("".join(rng.choice(list("abcdé"), 4)) for _ in range(n))
    passage, other = word(40), word(30)
    texts = [word(50) + passage + word(5), passage[10:] + word(30), other + word(3) + other, "ab" * 300, "ab" * 150 + "c", "z" * 99, "z" * 100, passage, passage, None, "", word(20) + passage[:120] + word(20)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts)


def test_repeats_across_the_pieces_of_a_long_text(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, suffix_dedup.PIECE + 20_000, dtype=np.uint8)).decode()
    border = suffix_dedup.PIECE
    texts = [long, "start " + long[border - 300 : border + 300] + " end", long[:500]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts)


def test_repeats_of_a_hot_anchor(spark, monkeypatch):
    """A line in most documents, in contexts of their own: no anchor's segments beyond ``HOT`` go to one sort."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(rng.choice(list("abcdé"), 4)) for _ in range(n))
    line = word(25)
    texts = [word(20) + line + word(20) for _ in range(60)] + [line, line + line, word(60), None]
    sizes, inner = [], suffix_dedup.sort_shards

    def spied(cuts):
        sizes.extend(r[0] for r in cuts.groupBy("anchor").agg(F.sum(F.octet_length("segment"))).select("sum(octet_length(segment))").collect())
        return inner(cuts)

    monkeypatch.setattr(suffix_dedup, "sort_shards", spied)
    monkeypatch.setattr(suffix_dedup, "HOT", 2000, raising=False)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts)
    assert sizes and max(sizes) <= 2000


def test_repeats_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "y" * 150), (4, "y" * 150), (4, "y" * 150), (None, None), (2**63 - 1, "q" * 120), (None, "q" * 120)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect())
    # Of equal texts, the smallest id is first, and ids that are null come last.
    assert got == {(4, 150, 149): 2, (None, 0, 0): 1, (None, 150, 150): 1, (2**63 - 1, 120, 119): 1, (None, 120, 120): 1}
    assert suffix_dedup.remove_repeats(rows.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aabÿ", min_size=1, max_size=300), st.booleans())
def test_induced_order_and_prefixes(text, spill):
    raw = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    held = induced_sort.BLOCK
    induced_sort.BLOCK = 5 if spill else held
    try:
        parts = list(induced_sort.sorted_suffixes(raw, 24, budget=200 if spill else 1 << 20))
    finally:
        induced_sort.BLOCK = held
    order, prefix = np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])
    cut = [bytes(raw[i : i + 24]) for i in order]
    assert sorted(order.tolist()) == list(range(len(raw))) and cut == sorted(cut)
    for i in range(1, len(cut)):
        same = next((k for k, (x, y) in enumerate(zip(cut[i - 1], cut[i])) if x != y), min(len(cut[i - 1]), len(cut[i])))
        assert min(24, prefix[i]) == same


# ---- 3 quality


def test_quality_shrinks_sparse_sites(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        site = f"site{i % 5}" if i < 595 else "lonely/page"
        rows.append((i, " ".join("word%d" % rng.integers(50) for _ in range(30)) + ("" if good else " ### $$$ ***" * 20), site, "en"))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows + [(600, None, None, None), (601, "", "", "")], "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels[:300] + [(1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(df, marks).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].kept == bool(q) for i, q in labels[300:]]) > 0.97
    assert quality.score_quality(df.where("doc_id >= 600"), marks).count() == 2
    none = quality.score_quality(df, marks.where("false"))
    assert {r.evidence for r in none.collect()} == {0.5}
    assert quality.score_quality(df.where("false"), marks).count() == 0


def test_quality_of_a_sparse_site_lies_between_its_own_rate_and_the_prior(spark):
    """Hosts apart in quality: a host of one document is drawn to the global mean, one of hundreds is not."""
    rows, labels = [], []
    for host, n, good in (("bad", 300, 0.1), ("fine", 300, 0.9), ("small", 1, 0.0), ("also", 1, 1.0)):
        for i in range(n):
            rows.append((len(rows), "same words in every text", f"{host}/p", "en"))
            labels.append((len(labels), int(i < good * n)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.score_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    prior = sum(q for _, q in labels) / len(labels)
    bad, fine, small, also = (got[i].host_posterior for i in (0, 300, 600, 601))
    assert abs(bad - 0.1) < 0.02 and abs(fine - 0.9) < 0.02
    assert 0.05 < small < prior < also < 0.95
    # Sparse hosts are shrunk by more than crowded ones, and paths lie between their hosts and their own rates.
    assert small - 0 > bad - 0.1 and 1 - also > 0.9 - fine
    assert got[600].path_posterior <= small and got[601].path_posterior >= also
    # Equal texts: only the site tells them apart.
    assert got[0].evidence == got[300].evidence and got[0].score < 0.5 < got[300].score


# ---- 4 decontamination


def test_leaks_copied_and_paraphrased(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(4000)] + ["the", "of", "and"] * 700
    prose = lambda n: [str(w) for w in rng.choice(words, n)]
    items = [prose(40) for _ in range(20)]
    texts = [prose(300) for _ in range(80)]
    truth = set()
    for k in range(15):
        copy = list(items[k])
        if k % 3 == 1:
            copy = [w for i, w in enumerate(copy) if i % 8]  # words dropped
        if k % 3 == 2:
            copy = [w if i % 6 else "changed" for i, w in enumerate(copy)]
        texts[k * 5][100:100] = copy
        truth.add((k * 5, k))
    df = docs(spark, [" ".join(t) for t in texts] + ["", None])
    bench = spark.createDataFrame([(i, " ".join(t).upper() + "!") for i, t in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == truth
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(df.where("false"), bench).count() == 0


def test_leaks_of_long_items_and_heavy_paraphrases(spark):
    """Copies of items far longer than a window, and of items with 30 to 38% of their words changed."""
    rng = np.random.default_rng(14)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(4000)]
    prose = lambda n: [str(w) for w in rng.choice(words, n)]
    items = [prose((30, 60, 200, 600)[i % 4]) for i in range(24)]
    texts, truth = [prose(300) for _ in range(60)], set()
    for k, item in enumerate(items):
        copy = list(item)
        for rate, doc in ((0.0, k), (0.3 + 0.04 * (k % 3), k + 30)):
            # Changed words are spread over the item and leave its answer.
            for at in rng.choice(np.arange(5, len(item)), int(rate * len(item)), replace=False):
                copy[at] = str(rng.choice(words))
            texts[doc][100:100] = copy
            truth.add((doc, k))
    bench = spark.createDataFrame([(i, " ".join(t), " ".join(t[:5])) for i, t in enumerate(items)], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert got == truth


def test_fit_sums_frequent_and_other_words_alike(spark):
    """A'(A Q) by products of counts and by gathers together is that of the plain matrix."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 5000) for n in (0, 3, 24, 25, 400, 2000)] + ["same " * 60]
    words, starts = decontaminate.batch_words(texts)
    idf = np.log1p(100 / (1 + np.bincount(decontaminate.buckets(words), minlength=decontaminate.BUCKETS)))
    basis = rng.standard_normal((decontaminate.BUCKETS, 4), dtype=np.float32)
    want = np.zeros(basis.shape)
    for a, b in zip(starts[:-1], starts[1:]):
        for low in range(a, b, decontaminate.WIDTH):
            row = np.bincount(decontaminate.buckets(words[low : min(b, low + decontaminate.WIDTH)]), minlength=decontaminate.BUCKETS) * idf
            norm = (idf[decontaminate.buckets(words[low : min(b, low + decontaminate.WIDTH)])] ** 2).sum()
            want += np.outer(row, row @ basis) * 2 / norm
    got = decontaminate.gram(spark.createDataFrame([(t, 2.0) for t in texts], "text string, weight double"), basis, idf)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_latent_space_is_fitted_on_all_documents(spark):
    """The word vectors are those of a subspace iteration over every passage, computed here as one dense matrix."""
    dice = random.Random(9)
    texts = [" ".join(f"w{dice.randrange(400)}" for _ in range(dice.randrange(1, 60))) for _ in range(3500)]
    items = [" ".join(f"w{dice.randrange(400)}" for _ in range(20)) for _ in range(30)]
    df = docs(spark, texts).repartition(13).select("doc_id", "text")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    counts, total = decontaminate.document_frequencies(df)
    idf = np.log1p(total / (1 + counts))
    found = decontaminate.latent_space(df, bench, idf, total)
    idf_used = np.flatnonzero(counts)
    weight, rows, scales = decontaminate.WEIGHT * (total / 2) / len(items), [], []
    for text, heavy in [(t, 1.0) for t in texts] + [(t, weight) for t in items]:
        cells = decontaminate.buckets(decontaminate.batch_words([text])[0])
        for at in range(0, len(cells), decontaminate.WIDTH):
            row = np.zeros(decontaminate.BUCKETS)
            part = cells[at : at + decontaminate.WIDTH]
            np.add.at(row, part, idf[part])
            rows.append(row[idf_used])
            scales.append(heavy / (idf[part] ** 2).sum())
    a, scales = np.array(rows, dtype=np.float64), np.array(scales)
    start = np.linalg.qr(np.random.default_rng(11).standard_normal((decontaminate.BUCKETS, decontaminate.RANK), dtype=np.float32))[0]
    basis = start[idf_used].astype(np.float64)
    for _ in range(decontaminate.ROUNDS):
        basis = np.linalg.qr(a.T @ ((a @ basis) * scales[:, None]))[0]
    ours = found[idf_used] / idf[idf_used, None]
    assert np.abs(ours @ ours.T - basis @ basis.T).max() < 0.01
    rest = np.setdiff1d(np.arange(decontaminate.BUCKETS), idf_used)
    assert not found[rest].any()


def test_leaks_by_length_and_kind(spark):
    """Recall for items of 4 to 500 words, in each kind of copy, in texts longer and shorter than a window."""
    rng = np.random.default_rng(24)
    common = [f"c{i}" for i in range(60)]
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(6000)]
    prose = lambda n: [str(rng.choice(common)) if rng.random() < 0.4 else str(rng.choice(words)) for _ in range(n)]

    def swapped(t):
        t = list(t)
        for i in range(0, len(t) - 1, 5):
            t[i], t[i + 1] = t[i + 1], t[i]
        return t

    kinds = {
        "verbatim": list, "reordered": swapped, "dropped": lambda t: [w for i, w in enumerate(t) if i % 5 != 2],
        "changed": lambda t: [str(rng.choice(common)) if i % 4 == 1 else w for i, w in enumerate(t)],
    }
    lengths = [4, 5, 6, 10, 24, 40, 80, 120, 240, 500]
    items = [prose(lengths[i % 10]) for i in range(60)]
    texts, truth = [prose(400) for _ in range(40)] + [["alone"]], {}
    for kind, change in kinds.items():
        for k, item in enumerate(items):
            # Few words can't be told from chance once some have changed.
            if kind == "verbatim" or len(item) >= 10:
                host = prose(int(rng.integers(0, 300)))
                at = len(host) // 2
                truth.setdefault((kind, len(item)), set()).add((len(texts), k))
                texts.append(host[:at] + change(item) + host[at:])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(98, "too few words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    missed = {x: len(pairs - got) / len(pairs) for x, pairs in truth.items()}
    assert max(missed.values()) <= 0.17 and not any(v for (kind, _), v in missed.items() if kind == "verbatim"), missed
    for kind in kinds:
        pairs = set().union(*(p for (k, _), p in truth.items() if k == kind))
        assert len(pairs & got) >= 0.9 * len(pairs), (kind, missed)
    assert got <= set().union(*truth.values())


def test_candidate_recall_on_planted_passages(spark, sf_dir):
    """Every planted passage of the smallest tables, found by plain search for eight words."""
    tables = {t: duckdb.sql(f"SELECT * FROM '{sf_dir}/{t}.parquet'").df() for t in ("documents", "benchmark")}
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = {}
    for i, t in zip(tables["benchmark"].item_id, tables["benchmark"].text):
        for k in range(len(cut(t)) - 7):
            grams.setdefault(tuple(cut(t)[k : k + 8]), set()).add(i)
    truth = {(d, i) for d, t in zip(tables["documents"].doc_id, tables["documents"].text) for k in range(len(cut(t)) - 7) for i in grams.get(tuple(cut(t)[k : k + 8]), ())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op4_latent_decontamination(spark, sf_dir).collect()}
    assert len(truth & got) >= 0.9 * len(truth) and got <= truth


# ---- 5 WARC


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n", "é\n" * 50, "<p>a</p>", ""]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(None, None, "lone"), (None, None, "<p>a</p>")], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    warc.write_archives(pages.repartition(3), scratch.path("a"), "<urn:uuid:t>", scratch)
    got = {r.page_id: r for r in warc.read_archives(spark, scratch.path("a"), "<urn:uuid:t>").collect() if r.page_id is not None}
    for i, h in enumerate(html):
        last = max(k for k, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i].record_type == ("response" if i == last else "revisit") and got[i].original == (None if i == last else last)
        assert got[i].digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        assert got[i].payload == ((h or "") if i == last else "")
    raw = b"".join(p.read_bytes() for p in Path(scratch.path("a").removeprefix("file://")).glob("part-*"))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    # Every record has a name, also without a page id, and a URL's control letters keep their codes.
    assert raw.count(b"WARC-Record-ID: <urn:page:") == 8 and raw.count(b"WARC-Record-ID: <urn:sha1:") == 2
    assert got[1].url == "http://h/1%0D%0AX:%20y"


def test_warc_least_size_and_empty(spark):
    rows = spark.createDataFrame([(1, "d", 3), (2, "d", 3)], "page_id long, digest string, payload_bytes long")
    assert {r.original for r in warc.resolve_revisits(rows, Scratch(spark, "t"), least=4).collect()} == {None}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    warc.write_archives(pages, scratch.path("a"), "<urn:uuid:t>", scratch)
    assert warc.read_archives(spark, scratch.path("a"), "<urn:uuid:t>").count() == 0


# ---- 6 BPE


def test_bpe_like_the_library(spark, bpe_file, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_file)
    texts = ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()] + ["日本語 テキスト\U0001f600" * 3, "a" * 3000, "12345,678 9"]
    got = {r.doc_id: r for r in bpe.encode(docs(spark, texts), bpe_file, lexicon=500, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs(spark, texts).where("false"), bpe_file).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i * i] for i, w in enumerate(sorted({a + b + c for a in ("", "re", "un") for b in ("do", "lock", "tie") for c in ("", "s", "ing", "er")}))}
    (tmp_path / "x").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    ids, sizes = lexicon.ids_of(lexicon.find(list(words)))
    assert ids.tolist() == [i for x in words.values() for i in x if True] and set(sizes) == {2}
    assert lexicon.find([b"undoin", b"\xff", b"undoinge"]).tolist() == [-1, -1, -1]
    assert bpe.Lexicon.find(lexicon, []).tolist() == []
    # All prefixes share one graph of stems and endings.
    assert len(lexicon.ends) < 25


def test_bpe_merges_many_like_one(bpe_file):
    vocab, rng = bpe.vocabulary(bpe_file), np.random.default_rng(2)
    words = [rng.choice(list("aeinrst thLING'".encode()), rng.integers(1, 70)).astype(np.uint8).tobytes() for _ in range(500)] + [b"\xff\xfe", b"a" * 47, b"a" * 49]
    ids, sizes = vocab.merge_many(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [vocab.merge(w) for w in words]
    assert vocab.written(ids)[:-1] == ",".join(map(str, ids.tolist())).encode() and vocab.decoded(ids) == b"".join(words)


def test_bpe_takes_long_texts_in_pieces(bpe_file, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "PIECE", 40)
    monkeypatch.setattr(bpe, "MEMO", 5)
    text = "It's  a long\n\n text\u3000 with <|endoftext|> all\tkinds of  space, isn't it? " * 20
    ids = bpe.Encoder(None, bpe.vocabulary(bpe_file)).encode([text, "", "x"])
    library = Tokenizer.from_file(bpe_file)
    assert [x.tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in (text, "", "x")]


# ---- 7 URL rules


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.net/en/1", "http://example.net/fr/", "http://x.org/fr/a?b", "https://net/", "http://notnet/", "http://a.net", "http://b.example.com/de/x#y", "http://cheap-pills.example.com/en", "nothing", None, "", "http://casino.biz/?net/", "http://a.net/x", "http://a.net/x"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = url_filter.SITE_RULES + url_filter.PATTERN_RULES + (url_filter.word_rule("any-question", r"\.biz", (), "block"),)
    got = {r.url: (r.site.name if r.site else None, r.pattern.verdict if r.pattern else None) for r in url_filter.judge_urls(rows, rules).collect()}
    want = ["example.net/en/", "net/", "org/fr/", "net/", None, None, "example.com/de/", None, None, None, None, None, "net/"]
    assert [got[u][0] for u in urls[:13]] == want
    assert got["http://cheap-pills.example.com/en"][1] == "block" and got["http://casino.biz/?net/"][1] == "block"
    assert url_filter.judge_urls(rows.where("false"), rules).count() == 0


def test_filter_list_lines():
    def fits(line, target):
        return re.search(url_filter.list_rule(line).pattern.replace(r"\z", r"\Z"), target) is not None

    assert fits("||ads.com^", "x.ads.com/a") and fits("||ads.com^", "ads.com") and not fits("||ads.com^", "bads.com/") and not fits("||ads.com^", "ads.com.org/")
    assert fits("/Banner/*/img^", "h/banner/9/IMG/") and not fits("/banner/*/img^", "h/banner/img-2") and fits("a.js|", "h/a.js") and not fits("a.js|", "h/a.jsx")
    assert url_filter.list_rule("||ads.com^").literals == ("ads", "com") and url_filter.list_rule("/banner/*/img9").literals == ("banner",)
    assert url_filter.list_rule("@@||ads.com/ok").verdict == "allow"
    for line in ("", "! x", "[Adblock]", "##.ad", "a.com##.ad", "||a.com^$third-party", "/ad[0-9]/", "|https://a.com", "**^"):
        assert url_filter.list_rule(line) is None, line


def test_many_rules_against_every_url(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh1"), rng.integers(1, 4))) for _ in range(60)]
    word = lambda: str(rng.choice(words))
    shapes = (
        lambda: f"||{word()}.{word()}^", lambda: f"/{word()}/*{word()}", lambda: f"@@||{word()}.net/{word()}", lambda: f"{word()}-{word()}^", lambda: f"*{word()}.{word()}|", lambda: f".{word()}{word()}{word()}",
    )
    rules = tuple(url_filter.list_rule(shapes[i % 6]()) for i in range(600))
    assert sum(not r.literals for r in rules) > 50
    rows = [(f"http://{word()}.{word()}.{rng.choice(['net', word(), 'COM'])}/{word()}/{word()}-{word()}{rng.choice(['', '/', '.' + word(), '?q=' + word()])}",) for _ in range(100)]
    rows += [("http://" + "a." * 50 + "net/" + "z" * 2000,), (None,), rows[0]]
    got = {r.url: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "url string").withColumns({c: F.lit("x") for c in ("host", "token", "id", "name", "n")}), rules).collect()}
    tried = [(re.compile(r.pattern.replace(r"\z", r"\Z")), (r.rank, r.name, r.verdict)) for r in rules]
    assert len(got) == len(set(rows)) and sum(r.pattern is not None for r in got.values()) > 10
    for r in got.values():
        want = max((best for pattern, best in tried if pattern.search(r.host + r.path)), default=None)
        assert (tuple(r.pattern) if r.pattern else None) == want, r.url


# ---- 8 language ID


def test_language_of_held_out_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.op8_language_id(spark, sf_dir).join(df.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    vocab = language_id.default_vocabulary()
    got = {r.doc_id: r for r in language_id.identify(docs(spark, ODD + ["123 456", "the house " * 30, "²", "x² m²"]).withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang"))), vocab).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 12, 14)] == ["und"] * 5 and got[13].lang_pred == got[15].lang_pred == "en"
    assert {r.lang_pred for r in language_id.identify(docs(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string")), vocab).collect()} == {"und"}
    assert language_id.identify(docs(spark, ODD).where("false"), vocab).count() == 0


def test_forward_sums_all_segmentations():
    vocab = language_id.pieces(language_id.default_vocabulary())
    rng = np.random.default_rng(0)
    probs = rng.random((len(vocab.names), 2))
    place = {p: i for i, p in enumerate(vocab.names)}

    def total(word, k):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in place:
                    sums[end] += sums[start] * probs[place[word[start:end]], k]
            if word[end - 1] not in place:
                sums[end] += sums[end - 1] * language_id.RARE
        return np.log(sums[-1])

    words = ["the", "house", "über", "a", "zzqq", "ж中"]
    assert np.allclose(language_id.word_scores(words, vocab, probs), [[total("▁" + w, k) for k in (0, 1)] for w in words])


# ---- 9 near dedup


def brute_near(texts, width, share):
    low = [re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())) for t in texts]
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for w in low]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width, exact", [(4, False), (5, False), (4, True)])
def test_near_groups_match_brute_force(spark, monkeypatch, width, exact):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "GROUP", 8)
    rng = np.random.default_rng(width)
    words = [f"w{i}" for i in range(500)]
    base = list(rng.choice(words, 150))
    texts = list(ODD)
    for i in range(60):  # a loose group that no single hub joins
        t = list(base)
        for _ in range(rng.integers(1, 7)):
            t[rng.integers(150)] = f"own{i}x{rng.integers(9)}"
        texts.append(" ".join(t))
    texts += [" ".join(base[:60]) + " " + " ".join(rng.choice(words, 60)) for _ in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(spark, texts), width=width, exact=exact).collect()}
    assert [got[i] for i in range(len(texts))] == brute_near(texts, width, 80)


def test_near_loose_groups_make_no_row_for_each_pair(spark, monkeypatch):
    """A group whose texts are all alike and none of them enough: tables of pairs grow with the texts."""
    rng, size = np.random.default_rng(9), 150
    base, texts = [f"w{i}" for i in range(160)], []
    for i in range(size):
        t = list(base)
        for at in rng.choice(160, 3, replace=False):
            t[at] = f"own{i}x{at}"
        texts.append(" ".join(t))
    rows, save = {}, Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        if set(df.columns) >= {"a", "b"}:
            rows[label] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(Scratch, "save", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(size)] == [c for _, c in brute_near(texts, 4, 80)]
    assert max(rows.values()) <= near_dedup.LISTED * size


def test_near_counts_of_shared_values():
    rng = np.random.default_rng(4)
    sets = [rng.choice(200, rng.integers(0, 90), replace=False).astype(np.int64) - 100 for _ in range(60)]
    sets += [np.array([k], dtype=np.int64) for k in (-(1 << 63), (1 << 63) - 1)] * 2
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    got = near_dedup.shared_counts(sets)
    np.fill_diagonal(got, 0)
    assert (got == want).all()


def test_near_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "alone")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in near_dedup.near_groups(rows).collect())
    assert got == {(None, 7): 1, (7, 7): 2, (None, None): 1}
    assert near_dedup.near_groups(rows.where("false")).count() == 0


def test_near_rows_that_share_an_id(spark):
    """Each text of a document links it, and the document links its texts."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, words("w", 40)), (2, words("w", 40) + " x"), (2, words("v", 60)), (3, words("v", 60) + " y"), (4, words("u", 30)), (5, words("u", 30)), (5, words("t", 9)), (6, words("t", 9)), (7, "alone here"), (5, words("w", 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for exact in (False, True):
        got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, exact=exact).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}


def test_samples_of_tiny_shares(spark):
    """At the share of 3,000 documents among 1e11, about as many keys are taken as are due, never none."""
    from lustrate.llm.sampling import sampled

    keys = spark.range(4_000_000)
    for share in (3e-6, 1e-4, 0.5):
        assert 0.3 * share < keys.where(sampled("id", share)).count() / 4e6 < 3 * share + 1e-9
    assert keys.where(sampled("id", 1.0)).count() == 4_000_000 and keys.where(sampled("id", 0.0)).count() == 0
    # Shares far under one in a million are told apart.
    hashes = spark.range(1).select(*[(F.lit(2**53 * s) > 0).alias(f"s{i}") for i, s in enumerate((3e-8, 2e-13))]).first()
    assert all(hashes) and len({2.0**53 * s for s in (3e-8, 2e-13, 1e-15)}) == 3


def test_quality_counts_a_document_once(spark):
    """On a site of one document the score takes the prior, not the document again."""
    rows = [(i, f"text of words {i}", f"big/{i % 2}", "en") for i in range(200)] + [(200, "text of words", "lonely/p", "en"), (201, "text of words", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(200, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(df, marks).collect()}
    unmarked = {r.doc_id: r for r in quality.score_quality(df, marks.where("doc_id < 200")).collect()}
    # Its label moves the site that others see, but its own score only through the prior of all.
    assert got[200].path_posterior > unmarked[200].path_posterior
    assert abs(got[200].score - got[201].score) < 0.02


def test_shingle_hashes_of_long_texts():
    text = (b"word%d " * 3) % (1, 2, 3) * 150_000
    (cells,) = shingle_sets([text], 4)
    assert len(cells) == 3
    a, b = shingle_sets([b"A b\tC d e", b"a B\nc D E"], 4)
    assert (a == b).all() and len(a) == 2
