"""Packing, spelling variants and token alignment against brute force and chosen odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lustrate.llm import packing, queries, spelling, token_alignment

WORD, BYTE, PIECE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, piece string, length string, n long, word string, _row string, _block string, keys string"
ODD = [
    "", None, " ", " \t\n", "A", "a  b", "  lead", "trail  ", "same text here", "same text here", "naïve café über straße", "日本語 と 中文 😀 emoji👩‍👩‍👧 end",
    "x" * 5000, "ab " * 3000, "a" * 300 + " " * 77 + "b", "it's 12 o'clock\r\n　ok <|endoftext|> <s> </s> <unk> <0x0A> <|startoftext|>z", "has ▁ piece mark", "nul \0 in", "é combining ﬁ",
    "\x1c odd\x85 space\xa0x", "Ünïcode ÀÉÎ×÷ÿ tail", "1234567890 3.14 -- ...", "�﻿ bom", "İstanbul ΣΑΣ", "it's I'LL 's'd x're!'ve a'b ''s µm ÀÉ×÷ ª²³ ¼ \x85\xa0x", "<|ENDOFTEXT|> 2024 3,14", "—, € 5%", "End.\nNext, (so) a-b a's! x×, ÷. https://www.a.com/?q=1&b_c=2#d e.g., U.S.A. [x] {y} z~ é. ß; ...a.. !a",
]


def docs(spark, texts, parts=3):
    """Rows with odd and clashing extra columns; ids are places."""
    return spark.createDataFrame([(i, t, "en", "p", "l", 0, "w", "r", "b", "k") for i, t in enumerate(texts)], DOCS).repartition(parts)


def given_texts(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


# Packing


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def fewest(items, capacity):
    """Fewest sequences, by trying all ways (small cases only)."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def histogram(items, capacity):
    return np.bincount(items, minlength=capacity + 1).astype(np.int64) if items else np.zeros(capacity + 1, np.int64)


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_the_fewest_sequences(case):
    capacity, items = case
    items = sorted(items, reverse=True)
    fixed, left = packing.reduced(histogram(items, capacity), capacity)
    rest = sorted((s for s in range(1, capacity + 1) for _ in range(int(left[s]))), reverse=True)
    assert Counter(rest) + sum((Counter({s: k * m for s, k in whole.items()}) for whole, m in fixed), Counter()) == Counter(items)
    assert all(sum(s * k for s, k in whole.items()) <= capacity for whole, _ in fixed)
    assert sum(m for _, m in fixed) + fewest(rest, capacity) == fewest(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_best_fit_is_that_of_single_items(case):
    capacity, items = case
    rooms = []
    for s in sorted(items, reverse=True):
        at = min((k for k in range(len(rooms)) if rooms[k] >= s), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    found = packing.best_fit(histogram(items, capacity), capacity)
    assert sorted(capacity - sum(s * k for s, k in whole.items()) for whole, m in found for _ in range(m)) == sorted(rooms)


def lower_bound(counts, c):
    """The Martello-Toth bound: large items each need a sequence, small ones fill what these leave."""
    sizes, best = np.arange(c + 1), 0
    for alpha in range(c // 2 + 1):
        one, two, three = sizes > c - alpha, (sizes <= c - alpha) & (2 * sizes > c), (sizes >= alpha) & (2 * sizes <= c)
        room = int((counts * (c - sizes))[two].sum())
        best = max(best, int(counts[one | two].sum()) + max(0, -(-(int((counts * sizes)[three].sum()) - room) // c)))
    return best


def test_plans_of_a_hundred_billion_documents_stay_small():
    counts = np.zeros(2049, np.int64)
    counts[1:] = np.random.default_rng(1).integers(1, 10**8, 2048)
    entries = packing.entries_of(contents := packing.plan(counts), 2048)
    assert len(entries) < 200_000 and sum(m for _, m in contents) <= lower_bound(counts, 2048) * 1.001
    for s in (1, 700, 2048):
        assert sum(whole.get(s, 0) * m for whole, m in contents) == counts[s]


def check_packed(rows, texts, word_ids, capacity=2048):
    expected = {}
    for i, t in enumerate(texts):
        ids = word_ids(t)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            expected[i, k // capacity] = (k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(expected)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(x[1] for x in expected.values()) // capacity)
    return len(held), least


def test_packed_documents(spark, sf_dir, word_ids):
    texts = given_texts(spark, sf_dir)
    used, least = check_packed(packing.pack(docs(spark, texts), WORD).collect(), texts, word_ids)
    assert used <= least * 1.02 + 1


def test_packing_of_odd_rows(spark, word_ids):
    texts = ODD * 2
    check_packed(packing.pack(docs(spark, texts), WORD).collect(), texts, word_ids)
    check_packed(packing.pack(docs(spark, texts), WORD, 16).collect(), texts, word_ids, 16)
    assert packing.pack(docs(spark, ["a"]).where("false"), WORD).collect() == []


def test_packing_reads_long_texts_in_portions(word_ids, monkeypatch):
    monkeypatch.setattr(packing, "PORTION", 10)
    encoder = packing.WordEncoder(WORD)
    texts = [t or "" for t in ODD]
    assert [x.tolist() for x in encoder.encode(texts)] == [word_ids(t) for t in texts]


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    """Brute force over (doc_id, text): {word: (form, root, n, n_near, form_n)}."""
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        out[w] = len(others)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), counts[w], out[w], counts[form[w]] if form[w] else None) for w in counts}


def as_found(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("small_shards", [False, True])
def test_spelling_variants_match_brute_force(spark, monkeypatch, small_shards):
    if small_shards:
        for name, value in (("SHARD_WORDS", 7), ("WAVE", 4000), ("TOGETHER", 5), ("MEMO", 10)):
            monkeypatch.setattr(spelling, name, value)
    dice = random.Random(5)
    words = ["".join(dice.choice("aabé") for _ in range(dice.randint(4, 7))) for _ in range(60)] + ["öffnung", "Öffnung", "hello", "helo", "hellooo", "xÿ×÷y"]
    texts = [" ".join(dice.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=60)).title() for _ in range(40)] + ODD * 3
    found = as_found(spelling.group_spellings(docs(spark, texts)))
    assert found == spelled(enumerate(texts)) and any(v[0] and v[1] != v[0] for v in found.values())


def test_spelling_query_matches_its_sql(spark, sf_dir):
    found = as_found(queries.QUERIES["op12_spelling_variants"](spark, sf_dir))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op12_spelling_variants"])
    assert rel.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found == {r[0]: r[1:] for r in rel.fetchall()} and len(found) > 1000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\U0001F600", max_size=6), max_size=30), st.lists(st.text("ab\U0001F600", max_size=7), min_size=1, max_size=10))
def test_automaton_on_tries(words, asked):
    words = sorted({w for w in words if w})
    trie = spelling.Trie.of_bytes(spelling.Trie.build(words, np.ones(len(words), np.int64)).to_bytes()) if words else spelling.Trie.build([], np.zeros(0, np.int64))
    w, k = trie.near(asked)
    assert sorted(zip(w.tolist(), k.tolist())) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b)]


def test_spelling_of_empty_tables_and_null_ids(spark):
    assert spelling.group_spellings(docs(spark, ["abcde"]).where("false")).collect() == []
    nulls = spark.createDataFrame([(None, "colour colour colour color color color color color color")], "doc_id long, text string")
    assert as_found(spelling.group_spellings(nulls))["colour"] == ("color", "color", 3, 1, 6)


# Token alignment


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    from lustrate.llm.bpe import byte_letters

    letters = byte_letters()

    def encode(text):
        """Whole texts through both libraries: ids and bytes of every token."""
        ids = a.encode(" " + text, add_special_tokens=False).ids
        pieces = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids], pieces

    return encode


def aligned(texts, encode):
    rows, links = [], []
    for text in texts:
        a, b = encode(text) if text else ([], [])
        if not text or b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
            rows.append([0, 0, 0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for cut in cuts:
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(([x for x, _ in a[i:i2]], [x for x, _ in b[j:j2]]))
            i, j = i2, j2
        links.append(Counter((x, y) for g, h in groups for x in g for y in h))
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append([len(a), len(b), len(groups), sum(links[-1].values()), 0, 0, hashlib.sha256(text.encode()).hexdigest()])
    counts = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for row, found in zip(rows, links):
        row[4] = sum(n for p, n in found.items() if counts[p] == most[p[0]])
        row[5] = sum(n * counts[p] for p, n in found.items())
    return {i: tuple(r) for i, r in enumerate(rows)}


def as_aligned(df):
    rows = df.collect()
    found = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("limit", [token_alignment.PAIRS, 300, 0])
def test_alignment_matches_brute_force(spark, sf_dir, both, limit):
    texts = ODD + [t for t in given_texts(spark, sf_dir) if not t or len(t) < 4000]
    assert as_aligned(token_alignment.align_tokenizers(docs(spark, texts), BYTE, PIECE, limit)) == aligned(texts, both)


def test_alignment_takes_long_texts_in_pieces(both, monkeypatch):
    from lustrate.llm import bpe

    monkeypatch.setattr(bpe, "PIECE", 20)
    monkeypatch.setattr(token_alignment, "PIECE", 30)
    monkeypatch.setattr(token_alignment, "MEMO", 5)
    monkeypatch.setattr(token_alignment, "STATES", 10)
    texts = [t or "" for t in ODD if not t or len(t) < 500] + [" ".join(f"word{i} and-so_on, {i}.5" for i in range(100))]
    found = token_alignment.Aligner(BYTE, PIECE).align(texts)
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in found] == [(r[0], r[1], r[2], r[3], r[6]) for r in aligned(texts, both).values()]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.sets(st.integers(1, 39)), st.sets(st.integers(1, 39)))
def test_transducer_closes_groups_where_both_end(data, a_cuts, b_cuts):
    cuts = [sorted({x for x in c if x < len(data)} | {0, len(data)}) for c in (a_cuts, b_cuts)]
    parts = [[data[x:y] for x, y in zip(c, c[1:])] for c in cuts]
    machine = token_alignment.Transducer(*(dict(enumerate(p)) for p in parts))
    shared = sorted(set(cuts[0]) & set(cuts[1]))[1:]
    ids = [list(range(len(p))) for p in parts]
    ends = [(cuts[0].index(x), cuts[1].index(x)) for x in shared]
    groups = [(ids[0][i:k], ids[1][j:m]) for (i, j), (k, m) in zip([(0, 0), *ends], ends)]
    for _ in range(2):  # the second time from the memo
        written, links = machine.align(*ids)
        assert written == [f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups]
        assert links == Counter(x << token_alignment.B_BITS | y for g, h in groups for x in g for y in h)
    assert machine.align(ids[0], ids[1][:-1]) is None


def test_alignment_of_empty_tables(spark):
    assert token_alignment.align_tokenizers(docs(spark, ["abc"]).where("false"), BYTE, PIECE).collect() == []
