"""Language identification by unigram pieces, marginalised over all segmentations.

The pieces are those of a given public vocabulary file (lower-cased); nothing about the vocabulary
is trained. Each language has a probability for each piece, fitted by expectation-maximisation on
word counts of a bounded sample of labelled documents (``per_language`` of each language, chosen by
a hash of the id). A text's likelihood under a language is the product over its words of the sum
over all segmentations of the word into pieces, computed by a forward recursion for many words at
once. Letters that no piece covers have a small fixed probability.

Results for odd input: a text that is null or has no letters is ``und`` with score 0; so is every
text when there are no labelled documents; words over ``LONGEST`` letters are cut into parts of that
length; repeated rows are judged alike; ties go to the language that sorts first; an empty table
gives no rows; other columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lustrate.llm.hashing import released
from lustrate.llm.sampling import sampled
from lustrate.scratch import Scratch, spread

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents of each language in the fit, rounds of the fit, and letters of a word's part.
PER_LANGUAGE, ROUNDS, LONGEST = 3000, 3, 40
#: Documents scored together, and words whose scores a worker keeps.
TOGETHER, MEMO = 256, 400_000
RARE = 1e-7


class Pieces:
    """The vocabulary's pieces, with a matcher for all of them at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.names = sorted(p for p in plain if re.fullmatch(r"▁?[^\W\d_]*", p) and p)
        self.matcher = ahocorasick.Automaton()
        for i, piece in enumerate(self.names):
            self.matcher.add_word(piece, (i, len(piece)))
        self.matcher.make_automaton()

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Word, start, end and piece of every match in ``words`` (each led by a word mark), and the
        longest length. A letter where no piece ends gets the piece -1, so every word has a path."""
        marked = ["▁" + w for w in words]
        text = "\n".join(marked)
        lengths = np.array([len(w) for w in marked], dtype=np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        found = np.fromiter((x for end, (piece, size) in self.matcher.iter(text) for x in (end + 1, size, piece)), dtype=np.int64).reshape(-1, 3)
        single = np.setdiff1d(np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) != 10), found[found[:, 1] == 1, 0] - 1)
        rows = np.concatenate([found, np.stack([single + 1, np.ones_like(single), np.full_like(single, -1)], axis=1)])
        word = np.searchsorted(begins, rows[:, 0] - 1, side="right") - 1
        end = rows[:, 0] - begins[word]
        return word, end - rows[:, 1], end, rows[:, 2], int(lengths.max())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def lattice(words: list[str], vocab: Pieces, probs: np.ndarray):
    """Forward sums of ``words`` (position, word, language) with the arcs sorted by their end."""
    word, start, end, piece, longest = vocab.arcs(words)
    order = np.lexsort((word, end))
    word, start, end, piece = word[order], start[order], end[order], piece[order]
    table = np.vstack([probs, np.full(probs.shape[1], RARE)])  # piece -1 is the last row
    weight = table[piece]
    alpha = np.zeros((longest + 1, len(words), probs.shape[1]))
    alpha[0] = 1
    cuts = np.searchsorted(end, np.arange(longest + 2))
    for at in range(1, longest + 1):
        a, b = cuts[at], cuts[at + 1]
        if a < b:
            into = word[a:b]
            first = np.flatnonzero(np.diff(into, prepend=-1))
            alpha[at, into[first]] = np.add.reduceat(alpha[start[a:b], into] * weight[a:b], first, axis=0)
    return alpha, word, start, end, piece, weight, cuts


def word_scores(words: list[str], vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word under each language."""
    alpha = lattice(words, vocab, probs)[0]
    lengths = np.array([len(w) + 1 for w in words])
    return np.log(np.maximum(alpha[lengths, np.arange(len(words))], 1e-300))


def expected_counts(words: list[str], counts: np.ndarray, language: np.ndarray, vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, for words seen ``counts`` times in ``language``."""
    alpha, word, start, end, piece, weight, cuts = lattice(words, vocab, probs)
    lengths = np.array([len(w) + 1 for w in words])
    beta = np.zeros_like(alpha)
    beta[lengths, np.arange(len(words))] = 1
    for at in range(alpha.shape[0] - 1, 0, -1):
        a, b = cuts[at], cuts[at + 1]
        np.add.at(beta, (start[a:b], word[a:b]), beta[at, word[a:b]] * weight[a:b])
    own = language[word]
    total = np.maximum(alpha[lengths, np.arange(len(words)), language], 1e-300)
    pick = np.arange(len(word))
    uses = alpha[start, word, own] * weight[pick, own] * beta[end, word, own] * (counts / total)[word]
    out = np.zeros((probs.shape[0] + 1, probs.shape[1]))
    np.add.at(out, (piece, own), uses)
    return out[:-1]


def parts(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    return words if all(len(w) <= LONGEST for w in words) else [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def has_letter(word: str) -> bool:
    """True also for words like ``x²``, whose other signs are no letters."""
    return word.isalpha() or any(map(str.isalpha, word))


def fit(labelled: DataFrame, vocab_path: str, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and a probability for each (piece, language), from ``labelled`` (doc_id, text, lang)."""
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    vocab = pieces(vocab_path)
    if not languages:
        return [], np.zeros((len(vocab.names), 0))
    rates = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    sample = labelled.where(sampled("doc_id", rates[F.col("lang")]))

    def count(batches):
        for batch in batches:
            seen = {}
            for text, lang in zip(batch["text"], batch["lang"]):
                seen.setdefault(lang, Counter()).update(parts(text or ""))
            for lang, words in seen.items():
                yield pd.DataFrame({"lang": lang, "word": list(words.keys()), "n": list(words.values())})

    scratch = Scratch(spark, "lang")
    words = scratch.save(sample.select("text", "lang").mapInPandas(released(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    number = {lang: i for i, lang in enumerate(languages)}
    probs = np.full((len(vocab.names), len(languages)), 1 / len(vocab.names))
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(probs)  # pieces x languages: bounded by the vocabulary

        def expect(batches):
            vocab, sums = pieces(vocab_path), None
            for batch in batches:
                for at in range(0, len(batch), 20_000):
                    some = batch.iloc[at : at + 20_000]
                    language = some["lang"].map(number).to_numpy()
                    found = expected_counts(some["word"].tolist(), some["n"].to_numpy(dtype=float), language, vocab, held.value)
                    sums = found if sums is None else sums + found
            if sums is not None:
                piece, language = np.nonzero(sums)
                yield pd.DataFrame({"piece": piece, "language": language, "uses": sums[piece, language]})

        rows = words.mapInPandas(released(expect), "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toPandas()
        sums = np.full(probs.shape, 0.01)
        sums[rows["piece"], rows["language"]] += rows["uses"]
        probs = sums / sums.sum(axis=0)
        held.unpersist()
    scratch.drop("words")
    return languages, probs


def predict(docs: DataFrame, vocab_path: str, languages: list[str], probs: np.ndarray, keep_text: bool = False) -> DataFrame:
    """``docs`` (text, and others that are kept) with lang_pred and score; text goes unless it is kept."""
    held = docs.sparkSession.sparkContext.broadcast(probs)
    docs = docs.drop("lang_pred", "score")
    others = [c for c in docs.columns if keep_text or c != "text"]
    schema = StructType([*(docs.schema[c] for c in others), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        vocab, rows, table = pieces(vocab_path), {}, np.zeros((0, len(languages)))
        for batch in batches:
            names, scores = [], []
            given = batch.column("text")
            for at in range(0, len(given), TOGETHER):
                texts = [parts(t) if t else [] for t in given.slice(at, TOGETHER).to_pylist()]
                new = list(set().union(*texts) - rows.keys())
                if len(rows) + len(new) > MEMO:
                    rows, table, new = {}, table[:0], list(set().union(*texts))
                if new and languages:
                    rows.update(zip(new, range(len(table), len(table) + len(new))))
                    table = np.vstack([table, *(word_scores(new[i : i + 10_000], vocab, held.value) for i in range(0, len(new), 10_000))])
                for words in texts:
                    if not languages or not any(map(has_letter, words)):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    logs = table[np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                    best = int(logs.argmax())
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*others, "lang_pred", "score"])

    return docs.mapInArrow(released(run), schema)


def held_out(doc_id):
    """True for the third of documents that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, vocab_path: str) -> tuple[list[str], np.ndarray]:
    """``fit`` on the labelled rows of ``docs`` (doc_id, text, lang) that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), vocab_path)


def identify(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    languages, probs = learn(docs, vocab_path)
    return predict(spread(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")), vocab_path, languages, probs)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_language_id(spark, sf_dir):
    """The language of every document, learned from two thirds of the labelled ones."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
