"""Groups of spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, so that words become reduced words, of which there are fewer. Words one edit apart have reduced
words that are equal or one edit apart. So each distinct reduced word makes its whole one-edit neighbourhood, as hashes that follow
from those of its prefixes and suffixes; these are joined with the reduced vocabulary, and pairs of words of joined reduced
words are verified letter by letter. Equal hashes of different reduced words only add pairs to verify.

A word's form is its most frequent neighbour, if that is at least twice as frequent; roots are found by doubling the way along forms.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, map_batches, materialize

#: What a run of letters consists of, once A-Z are lower-cased.
LETTERS = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
_RUN = "[A-Za-zÀ-ÿ]+"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Hashes that a task makes at a time.
_MOST = 400_000


@dataclass(frozen=True)
class SpellingParams:
    """symbols: of the reduced alphabet, ten at most. Words have at least so many letters and occurrences; a form at least `times` the word's."""

    symbols: int = 6
    letters: int = 5
    occurrences: int = 3
    times: int = 2
    #: One of so many runs of letters, by the hash of document and run, loses a letter (a planted misspelling). 0: none.
    garbled: int = 97


def symbols(p: SpellingParams) -> str:
    """The digit of each letter of LETTERS."""
    return "".join(str(zlib.crc32(c.encode()) % p.symbols) for c in LETTERS)


def vocabulary(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n: the runs of letters of whole texts with A-Z lower-cased, one in `garbled` of them less a letter, that are long and frequent enough."""
    lowered = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(lowered, F.lit(_RUN), F.lit(0))).alias("run")).where(F.length("run") >= p.letters)
    word = F.col("run")
    if p.garbled:
        h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % p.garbled == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= p.letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= p.occurrences)


def _mix(x: np.ndarray, length: int) -> np.ndarray:
    x = x ^ np.uint64(length * _INVERSE % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _sums(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equally long words (a row each): sums of (digit + 1) * base ** place over each prefix, and the powers."""
    n, length = digits.shape
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length + 1, _BASE, np.uint64))])
    prefix = np.zeros((n, length + 1), np.uint64)
    np.cumsum((digits + np.uint64(1)) * powers[:length], axis=1, dtype=np.uint64, out=prefix[:, 1:])
    return prefix, powers


def _digits(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places among the words, and digits, of those of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, _MOST // max(1, length))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            data = "".join(words[k] for k in part).encode()
            yield part, (np.frombuffer(data, np.uint8).reshape(len(part), length) - 48).astype(np.uint64)


def hashes(reduced: list[str]) -> np.ndarray:
    out = np.zeros(len(reduced), np.int64)
    for at, digits in _digits(reduced):
        out[at] = _mix(_sums(digits)[0][:, -1], digits.shape[1])
    return out


def neighbourhoods(reduced: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of hashes: each reduced word with itself and with all words of k symbols one edit apart, each once, in parts of a bounded size.

    Leaving out one of some equal symbols in a row gives the same word, as does adding one to them: the last, or first, stands for all.
    """
    for _, digits in _digits(reduced):
        n, length = digits.shape
        prefix, powers = _sums(digits)
        whole = prefix[:, -1]
        own = _mix(whole, length)
        yield own, own
        step = max(1, _MOST // (n * k))
        for i in range(0, length + 1, step):
            j = min(i + step, length + 1)
            inner = slice(i, min(j, length))
            held, power = digits[:, inner], powers[inner]
            # left out
            after = np.concatenate([digits[:, i + 1 : inner.stop + 1], np.full((n, max(0, inner.stop + 1 - length)), k, np.uint64)], axis=1)[:, : held.shape[1]]
            row, col = np.nonzero(held != after)
            yield own[row], _mix((prefix[row, i + col] + (whole[row] - prefix[row, i + col + 1]) * np.uint64(_INVERSE)), length - 1)
            # another symbol
            for c in range(k):
                row, col = np.nonzero(held != c)
                yield own[row], _mix(whole[row] + (np.uint64(c) - held[row, col]) * power[col], length)
            # one more
            before = np.concatenate([np.full((n, 1), k, np.uint64), digits], axis=1)[:, i:j]
            for c in range(k):
                row, col = np.nonzero(before != c)
                start = prefix[row, i + col]
                yield own[row], _mix(start + np.uint64(c + 1) * powers[i + col] + (whole[row] - start) * np.uint64(_BASE), length + 1)


def _meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join in which both sides are shuffled. They grow with the vocabulary, the neighbourhoods a hundredfold, and Spark takes the latter for no
    larger than the words they are made of: left alone it collects either on the driver."""
    return left.join(right.hint("merge"), on, how)


def near_words(words: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n, other, other_n: all pairs of words, either way, that differ by exactly one inserted, deleted or replaced letter."""
    reduced = words.select("word", "n", F.translate("word", LETTERS, symbols(p)).alias("reduced"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"word": b.column("word"), "n": b.column("n"), "of": pa.array(hashes(b.column("reduced").to_pylist()))})

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, other in neighbourhoods(b.column("reduced").to_pylist(), p.symbols):
                yield pa.RecordBatch.from_pydict({"of": pa.array(own), "near": pa.array(other)})

    held = materialize(map_batches(reduced, named, "word string, n long, of long"), "spelling-words")
    made = map_batches(reduced.select("reduced").distinct(), around, "of long, near long")
    pairs = materialize(_meet(made, held.select(F.col("of").alias("near")).distinct(), "near"), "spelling-pairs")
    left = _meet(held, pairs, "of").drop("of")
    right = held.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("of").alias("near"))
    return _meet(left, right, (left["near"] == right["near"]) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def variants(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """Per word: word, form, root (string), n, n_near, form_n (long).

    Null texts have no words; a row without doc_id counts as one of an empty id. Repeated rows count as often as they occur; ties of
    the most frequent near word go to the smallest; other columns are ignored; an empty table gives an empty result. Words of any length
    take part: what a word makes grows with its length.
    """
    p = params
    words = materialize(vocabulary(docs, p), "spelling-vocabulary")
    best = near_words(words, p).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    found = _meet(words, best, "word", "left")
    form = F.col("best.n") * -1 >= F.col("n") * p.times
    found = materialize(found.select("word", F.when(form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, -F.col("best.n")).alias("form_n")), "spelling-forms")
    way = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-way")
    most = found.agg(F.max("n")).first()[0] or 1
    # n grows by `times` with each step along forms, so the way has at most so many steps
    for _ in range(math.ceil(math.log2(max(2.0, math.log(most, p.times) + 1)))):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = materialize(_meet(way, on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-way")
        discard(way)
        way = longer
    return _meet(found, way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
