"""Language identification by unigrams over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum, over all
ways to cut it into pieces, of the product of their probabilities; a forward algorithm computes it. A text's score is the
product over its words. Distributions are learned by expectation maximisation: the expected count of each piece under all
segmentations of the labelled words.

Words are the runs of letters of the lower-cased text. A letter that no piece covers counts as one fallback piece.

A text may be in none of the learned languages. That alternative has the probability that a text of as many letters and words
would have in the likeliest language if it were unusually improbable: its share of the posterior lowers the score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import is_held_out, map_batches, materialize, slices
from evidentia.llm.vocab import SPACE, TOKENIZER_DIR, PieceTable, model_bytes, piece_table

#: A word: letters by their Unicode category, with which Spark's expression agrees.
LETTERS = r"\p{L}+"
WORD = regex.compile(LETTERS)
#: Probability of any one letter given the fallback piece.
FALLBACK = 1e-4
#: A text of no learned language: so many times the usual log probability of a letter, and so many standard deviations of its words besides.
UNLIKE, DEVIATIONS = 2.5, 6.0
#: Positions after which the running probabilities of long words are scaled.
RESCALE = 16


def _groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with the space mark before them as code points, by length: (their places, matrix)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        n = int(lengths[at[0]])
        for part in np.array_split(at, max(1, len(at) * n // 1_000_000)):
            codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            yield part, np.concatenate([np.full((len(part), 1), ord(SPACE), np.uint32), codes], axis=1)


def _edges(table: PieceTable, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For each start: (length, piece rows). Row -2 of a model is the fallback piece, row -1 is impossible."""
    out = []
    for start in range(codes.shape[1]):
        found = []
        for k, ids in table.spans(codes, start):
            if k == 1:
                found.append((k, np.where(ids < 0, -2, ids)))
            elif (ids >= 0).any():
                found.append((k, ids))
        out.append(found)
    return out


def word_log_probs(table: PieceTable, model: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns of model)."""
    out = np.zeros((len(words), model.shape[1]))
    for at, codes in _groups(words):
        n, size = codes.shape[1], len(at)
        ahead = {0: np.ones((size, model.shape[1]))}
        scale = np.zeros((size, model.shape[1]))
        for start in range(n):
            here = ahead.pop(start)
            if start % RESCALE == RESCALE - 1:
                top = here.copy()
                for v in ahead.values():
                    np.maximum(top, v, out=top)
                here /= top
                for v in ahead.values():
                    v /= top
                scale += np.log(top)
            for k, ids in table.spans(codes, start):
                if k == 1:
                    ids = np.where(ids < 0, -2, ids)
                elif not (ids >= 0).any():
                    continue
                add = here * model[ids]
                if start + k in ahead:
                    ahead[start + k] += add
                else:
                    ahead[start + k] = add
        out[at] = np.log(ahead[n]) + scale
    return out


def expected_counts(table: PieceTable, probs: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in the words, under all segmentations, for one language.

    The probabilities of all positions are kept as mantissas with a logarithm of their own, so that words may be of any length.
    """
    total = np.zeros(len(probs))
    for at, codes in _groups(words):
        n, size = codes.shape[1], len(at)
        rest = table.longest
        # forward[e], scaled by exp(up[e]); the last `rest` positions share the scale of the newest
        forward, up = np.zeros((n + 1, size)), np.zeros((n + 1, size))
        forward[0] = 1
        edges = _edges(table, codes)
        into: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for k, ids in edges[start]:
                into[start + k].append((start, k, ids))
        for e in range(1, n + 1):
            low = max(0, e - rest)
            top = up[low:e].max(axis=0)
            for start, _, ids in into[e]:
                forward[e] += forward[start] * np.exp(up[start] - top) * probs[ids]
            usable = forward[e] > 0
            up[e] = top + np.log(np.where(usable, forward[e], 1))
            forward[e] = usable
        backward, down = np.zeros((n + 1, size)), np.zeros((n + 1, size))
        backward[n] = 1
        for start in range(n - 1, -1, -1):
            top = down[start + 1 : start + rest + 1].max(axis=0)
            for k, ids in edges[start]:
                backward[start] += probs[ids] * backward[start + k] * np.exp(down[start + k] - top)
            usable = backward[start] > 0
            down[start] = top + np.log(np.where(usable, backward[start], 1))
            backward[start] = usable
        for start in range(n):
            for k, ids in edges[start]:
                log_share = up[start] + down[start + k] - up[n]
                n_used = forward[start] * probs[ids] * backward[start + k] * np.exp(np.minimum(log_share, 700)) * weights[at]
                total += np.bincount(ids % len(probs), n_used, len(probs))
    return total


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """Language, words and their counts, for each language of each batch of (lang, word, count)."""
    for b in batches:
        of: dict[str, list[int]] = defaultdict(list)
        for i, lang in enumerate(b.column("lang").to_pylist()):
            of[lang].append(i)
        words, n = b.column("word").to_pylist(), b.column("count").to_numpy().astype(float)
        for lang, at in of.items():
            yield lang, [words[i] for i in at], n[at]


@dataclass(frozen=True)
class LanguageModel:
    """languages[j] has the piece probabilities probs[:, j]; the last two rows are the fallback and the impossible piece.

    per_letter[j]: mean log probability of a letter of learned words; spread[j]: standard deviation of a word's from its letters' mean.
    """

    languages: tuple[str, ...]
    probs: np.ndarray
    vocabulary: bytes
    per_letter: np.ndarray
    spread: np.ndarray


def fit(labelled: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, max_docs_per_language: int = 1500, rounds: int = 2, smoothing: float = 0.1) -> LanguageModel:
    """Learn from rows (doc_id, text, lang) with a language.

    max_docs_per_language bounds the labelled rows that are used, in expectation: a language with more is thinned by a hash of
    doc_id. Each round is a Spark job over the distinct words of the sample; only languages x vocabulary numbers reach the driver.
    """
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    vocabulary = model_bytes(tokenizer_dir)
    table = piece_table(vocabulary)
    languages = tuple(sorted(sizes))
    n = len(table.pieces) + 2
    probs = np.full((n, len(languages)), 1.0 / n)
    probs[-2], probs[-1] = FALLBACK / n, 0
    if not languages:
        return LanguageModel((), probs, vocabulary, np.zeros(0), np.zeros(0))
    keep = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_docs_per_language / v)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) < keep[F.col("lang")] * 1_000_003)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    counted = materialize(sample.select("lang", words.alias("word")).groupBy("lang", "word").count(), "lang-words")
    place = {x: j for j, x in enumerate(languages)}
    for _ in range(rounds):
        now = probs

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            tab = piece_table(vocabulary)
            for lang, words, n in _by_language(batches):
                c = expected_counts(tab, now[:, place[lang]], words, n)
                ids = np.flatnonzero(c)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(ids), pa.string()), "piece": pa.array(ids, pa.int32()), "n": pa.array(c[ids])})

        # languages x vocabulary rows at most
        got = map_batches(counted, expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        probs = np.full((n, len(languages)), smoothing)
        np.add.at(probs, (got.column("piece").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]), got.column("n").to_numpy())
        probs /= probs.sum(axis=0)
        probs[-2] *= FALLBACK
        probs[-1] = 0
    final = probs

    names = ("n", "l", "p", "pp", "pl", "ll")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = piece_table(vocabulary)
        for lang, words, n in _by_language(batches):
            log_p, size = word_log_probs(tab, final[:, [place[lang]]], words)[:, 0], np.fromiter(map(len, words), float, len(words))
            values = (n, n * size, n * log_p, n * log_p**2, n * log_p * size, n * size**2)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string())} | {c: pa.array([v.sum()], pa.float64()) for c, v in zip(names, values, strict=True)})

    got = map_batches(counted, sums, "lang string, " + ", ".join(f"{c} double" for c in names)).groupBy("lang").agg(*[F.sum(c).alias(c) for c in names]).collect()
    per_letter, spread = np.zeros(len(languages)), np.zeros(len(languages))
    for r in got:
        j, m = place[r["lang"]], r["p"] / r["l"]
        per_letter[j], spread[j] = m, np.sqrt(max(0.0, r["pp"] - 2 * m * r["pl"] + m * m * r["ll"]) / r["n"])
    return LanguageModel(languages, probs, vocabulary, per_letter, spread)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each whole text and its posterior probability, all languages and none of them being equally likely before."""
    tokens: dict[str, int] = defaultdict(count().__next__)
    ids = []
    for t in texts:
        split = t.lower().split() if t else []
        ids.append(np.fromiter(map(tokens.__getitem__, split), np.int64, len(split)))
    words: dict[str, int] = defaultdict(count().__next__)
    inside = [[words[w] for w in WORD.findall(x)] for x in tokens]
    if not words or not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    per_word = word_log_probs(piece_table(model.vocabulary), model.probs, list(words))
    n_inside = np.fromiter(map(len, inside), np.int64, len(inside))
    at, of_token = np.fromiter(chain.from_iterable(inside), np.int64), np.repeat(np.arange(len(inside)), n_inside)
    n_letters = np.bincount(of_token, np.fromiter(map(len, words), float, len(words))[at], len(inside))
    per_token = np.stack([np.bincount(of_token, column[at], len(inside)) for column in per_word.T], axis=1)
    names, scores = [], np.zeros(len(texts))
    for j, mine in enumerate(ids):
        if not n_inside[mine].any():
            names.append("und")
            continue
        total = per_token[mine].sum(axis=0)
        best = int(total.argmax())
        names.append(model.languages[best])
        strange = UNLIKE * model.per_letter[best] * n_letters[mine].sum() - DEVIATIONS * model.spread[best] * np.sqrt(n_inside[mine].sum())
        scores[j] = 1 / (np.exp(total - total[best]).sum() + np.exp(min(700.0, strange - total[best])))
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, then the language and its score, under these names.

    A null text or one without a letter (by Unicode category) gets `und` and 0. A low score says that the text is in two languages
    or in none that was learned. Ties go to the language that sorts first. Repeated rows are scored
    alike. Columns of docs with those names are replaced.
    """
    base = docs.drop(*names)
    schema = T.StructType([*base.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, scores = score_texts(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *names])

    return map_batches(base, run, schema)


def identify(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, max_docs_per_language: int = 1500) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; the model is learned from the rows that aren't held out."""
    model = fit(docs.where(~is_held_out()), tokenizer_dir, max_docs_per_language)
    return predict(docs.select("doc_id", is_held_out().alias("held_out"), "text"), model).drop("text")
