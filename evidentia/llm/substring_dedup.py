"""Repeated passages: runs of consecutive sentences that occur more than once in the corpus.

Sentences end at full stops and line ends; nothing is lost, white space stays with the sentence before it. At every sentence begins a
run, and at every one a run ends: the shortest of at least `sentences` sentences and `words` words. Longer runs that repeat consist of
these.

A passage may stand in the midst of sentences, or have no full stops at all. So there are runs of pieces too: besides at sentence ends,
texts are cut after each word whose hash is the least of some `window` consecutive words, which depends on these words alone. Texts
that share a passage are cut alike in it but for fewer than `window` words at its borders. Runs of pieces have at least `long` words.

Runs of the same words, lower-cased, are alike; their keys have 128 bits. The first occurrence of a run is that in the smallest doc_id,
and there the earliest; all words that any other occurrence covers are removed, but for those in the same document that overlap the
first one (a word that goes on and on is no repeated passage until it fills two runs).

Runs are found in two steps. Only those of sentences that have a hash, and those of pieces that hold an anchor, which several documents
have, get keys and are joined globally. Anchors are six-word strings whose hash is the least of those in `long` consecutive words, so
that all occurrences of a run hold the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import discard, join_by_key, map_batches, materialize, slices

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words of an anchor.
_ANCHOR = 6
CUTS, COUNTED, MARKS, KEY = "evidentia_cuts", ("n_sentences", "n_removed"), "evidentia_marks", ["evidentia_doc", "evidentia_text"]
#: A mark of documents in which something repeats; others are even for anchors and odd for runs of sentences.
_AGAIN = -1


@dataclass(frozen=True)
class SpanParams:
    """Least sentences and words of a run of sentences, and words of a run of pieces. A passage of 51 words anywhere in a text has 36 or more in whole pieces."""

    sentences: int = 2
    words: int = 15
    long: int = 30
    window: int = 4


#: Bytes of a text whose words are hashed at a time.
_BYTES = 1 << 20


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the bytes."""
    space = np.ones(len(data) + 2, bool)
    np.take(_SPACE, np.frombuffer(data, np.uint8), out=space[1:-1])
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, with A-Z lower-cased: a sum of byte * base ** place within the word, mixed with its length."""
    out, codes, i = np.empty(len(begin), np.uint64), np.frombuffer(data.lower(), np.uint8), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _BYTES, side="right")))
        low, high = int(begin[i]), int(end[j - 1])
        prefix = prefixes(codes[low:high].astype(np.uint64))
        out[i:j] = _string_hashes(prefix, begin[i:j] - low, end[i:j] - low).view(np.uint64)
        i = j
    return out


#: Low bits of a packed hash, which hold the place, and words of a text that are packed at a time.
_PLACE = np.uint64((1 << 20) - 1)


def window_least(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of consecutive places, the place of its least hash (by 44 bits), the last of equal ones."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, most = np.empty(n, np.int64), int(_PLACE)
    for i in range(0, n, most - window):
        part = h[i : i + most]
        # later places are less
        v = (part & ~_PLACE) | (_PLACE - np.arange(len(part), dtype=np.uint64))
        wide = 1
        while wide * 2 <= window:
            v = np.minimum(v[:-wide], v[wide:])
            wide *= 2
        if wide < window:
            v = np.minimum(v[: len(part) - window + 1], v[window - wide :])
        out[i : i + len(v)] = i + (_PLACE - (v & _PLACE)).astype(np.int64)
    return out


def least(h: np.ndarray, window: int) -> np.ndarray:
    """Places that are the least of some window."""
    found = np.zeros(len(h), bool)
    found[window_least(h, window)] = True
    return np.flatnonzero(found)


class _Powers:
    """Powers of both factors, as many as the longest text so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = min(max(2 * n, 1 << 12), max(n, 1 << 22)) + 1
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f, np.uint64))]) for f in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(h: np.ndarray) -> np.ndarray:
    """Sums of hash * base ** place over each prefix, from which hashes of strings of words follow."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _POWERS.of(len(h))[0][: len(h)], dtype=np.uint64, out=out[1:])
    return out


def _string_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings of words from starts to ends."""
    x = ((prefix[ends] - prefix[starts]) * _POWERS.of(len(prefix))[1][starts]) ^ (ends - starts).astype(np.uint64)
    return _mixed(x).view(np.int64)


def borders(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's part of the bytes begins (the first one at 0, and after the last the end), and the number of words up to each sentence's end."""
    if not len(begin):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(data, np.uint8)
    last = _STOP[codes[end - 1]]
    # line ends, each after the word that ends before it
    last[np.maximum(np.searchsorted(end, np.flatnonzero(codes == 10), side="right") - 1, 0)] = True
    last[-1] = True
    return np.concatenate([[0], begin[1:], [len(data)]]), np.flatnonzero(last) + 1


def piece_ends(h: np.ndarray, ends: np.ndarray, p: SpanParams) -> np.ndarray:
    """The number of words up to each piece's end."""
    last = np.zeros(len(h) + 1, bool)
    last[ends] = True
    last[least(h, p.window) + 1] = True
    return np.flatnonzero(last)


def split_sentences(text: str) -> list[str]:
    """Sentences that joined give the text. A text without a word is one."""
    data = text.encode("utf-8", "surrogatepass")
    at, ends = borders(data, *word_places(data))
    places = at[ends].tolist() or [len(data)] * bool(data)
    return [data[i:j].decode("utf-8", "surrogatepass") for i, j in zip([0, *places], places, strict=False)]


def run_bounds(ends: np.ndarray, parts: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end (exclusive) of each run of at least so many parts and words: those from each part on, then others to each part; ends counts the words up to each part's end."""
    n = len(ends)
    words = np.concatenate([[0], ends]).astype(np.int64)
    every = np.arange(n)
    onward = np.maximum(every + parts, np.searchsorted(words, words[:n] + least_words))
    back = np.minimum(every + 1 - parts, np.searchsorted(words, words[1:] - least_words, side="right") - 1)
    from_here, to_here = np.flatnonzero(onward <= n), np.flatnonzero(back >= 0)
    to_here = to_here[onward[back[to_here]] != to_here + 1]
    return np.concatenate([words[from_here], words[back[to_here]]]), np.concatenate([words[onward[from_here]], words[to_here + 1]])


def runs(h: np.ndarray, ends: np.ndarray, p: SpanParams) -> tuple[np.ndarray, np.ndarray, int]:
    """First word and end of each run, those of sentences first, of which there are so many."""
    one, two = run_bounds(ends, p.sentences, p.words), run_bounds(piece_ends(h, ends, p), 1, p.long)
    return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), len(one[0])


def anchors(h: np.ndarray, prefix: np.ndarray, p: SpanParams) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the string of an anchor's length at each word, and for each `long` consecutive words, the place of their anchor."""
    size = min(_ANCHOR, p.long)
    every = np.arange(max(len(h) - size + 1, 0))
    x = _string_hashes(prefix, every, every + size)
    return x, window_least(x.view(np.uint64), p.long - size + 1)


def _firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, first = np.unique(h, return_index=True)
    return first.astype(np.int32), kept


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key: places in a text hold for the rows of the same doc_id and text."""
    return docs.withColumn(KEY[0], F.col("doc_id")).withColumn(KEY[1], F.xxhash64("text"))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.explode(F.arrays_zip("ats", "hs")).alias("s")).select(*KEY, F.col("s.ats").alias("at"), F.col("s.hs").alias("h"))


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.Array:
    """A list per part, of so many of the values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)), values)


def _rows(b: pa.RecordBatch, ats: list[np.ndarray], hs: pa.Array) -> pa.RecordBatch:
    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ats]).astype(np.int32))
    return pa.RecordBatch.from_pydict({c: b.column(c) for c in KEY} | {"ats": _lists(ats, flat), "hs": _lists(ats, hs)})


def marks_of(text: str, p: SpanParams) -> tuple[np.ndarray, np.ndarray]:
    """Marks and hashes of the text's anchors and runs of sentences, each at its earliest, and the mark of a text in which one of them repeats."""
    data = text.encode("utf-8", "surrogatepass")
    places = word_places(data)
    h = word_hashes(data, *places)
    prefix = prefixes(h)
    x, at = anchors(h, prefix, p)
    x = x[np.flatnonzero(np.bincount(at, minlength=len(x)))] if len(at) else x[:0]
    y = _string_hashes(prefix, *run_bounds(borders(data, *places)[1], p.sentences, p.words))
    (at, x_kept), (run, y_kept) = _firsts(x), _firsts(y)
    again = len(x_kept) < len(x) or len(y_kept) < len(y)
    return np.concatenate([2 * at, 2 * run + 1, np.full(int(again), _AGAIN, np.int32)]).astype(np.int32), np.concatenate([x_kept, y_kept, np.zeros(int(again), np.int64)])


def mark_rows(docs: DataFrame, p: SpanParams) -> DataFrame:
    """The key, at, h: see `marks_of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [marks_of(t or "", p) for t in b.column("text").to_pylist()]
            yield _rows(b, [a for a, _ in found], pa.array(np.concatenate([np.zeros(0, np.int64), *[h for _, h in found]])))

    return _exploded(map_batches(docs.select(*KEY, "text"), run, "evidentia_doc long, evidentia_text long, ats array<int>, hs array<long>"))


def marked_runs(text: str, marks: np.ndarray, p: SpanParams) -> tuple[np.ndarray, np.ndarray]:
    """Place among the runs and key (two numbers) of those runs, each once, that are marked, or whose anchors are."""
    data = text.encode("utf-8", "surrogatepass")
    places = word_places(data)
    h = word_hashes(data, *places)
    prefix = prefixes(h)
    starts, stops, n = runs(h, borders(data, *places)[1], p)
    m = marks[marks >= 0]
    chosen = np.zeros(len(starts), bool)
    chosen[m[m % 2 == 1] // 2] = True
    x, at = anchors(h, prefix, p)
    if len(at):
        anchored = np.flatnonzero(np.bincount(at, minlength=len(x)))
        known = np.isin(x, x[anchored[m[m % 2 == 0] // 2]])
        # all occurrences of a run hold the anchors of its first and its last words
        chosen[n:] = known[at[starts[n:]]] & known[at[stops[n:] - p.long]]
    place = np.flatnonzero(chosen)
    first, hashes = _firsts(_string_hashes(prefix, starts[place], stops[place]))
    place = place[first]
    # the other half of the key, from words hashed otherwise
    other = _string_hashes(prefixes(_mixed(h)), starts[place], stops[place])
    return place.astype(np.int32), np.stack([hashes, other], axis=1)


def spans(docs: DataFrame, p: SpanParams) -> tuple[DataFrame, DataFrame]:
    """The key, at, h: the earliest occurrence within each document of each run that several documents may have; at is its place among
    the runs. And the keys of documents in which something repeats."""
    found = materialize(mark_rows(docs.where("doc_id is not null"), p), "marks-found")
    again = materialize(found.where(F.col("at") == _AGAIN).select(*KEY).distinct(), "again")
    found_in = found.where(F.col("at") != _AGAIN)
    # a mark occurs once in a document at most here, so two documents make it a repeated one
    repeated = materialize(found_in.groupBy("h").agg(F.min(KEY[0]).alias("first"), F.max(KEY[0]).alias("last"), F.count("*").alias("n")).where("first != last").select("h", "n"), "repeated")
    marks = join_by_key(found, repeated, "h", "n", "inner").where(F.col("at") != _AGAIN).groupBy(*KEY).agg(F.collect_set("at").alias(MARKS))
    marks = materialize(marks, "marks")
    discard(found, repeated)
    marked = docs.select(*KEY, "text").join(marks, KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            done = [marked_runs(t, np.array(m, np.int64), p) for t, m in zip(b.column("text").to_pylist(), b.column(MARKS).to_pylist(), strict=True)]
            keys = np.concatenate([np.zeros((0, 2), np.int64), *[k for _, k in done]])
            hs = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, 16 * len(keys) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])
            yield _rows(b, [a for a, _ in done], hs)

    return _exploded(map_batches(marked, run, "evidentia_doc long, evidentia_text long, ats array<int>, hs array<binary>")), again


def cut(text: str | None, found: list[int] | None, p: SpanParams) -> tuple[str | None, int, int]:
    """The text without the given runs, wherever they stand, and without runs that stood wholly before in it; sentences, and how many of them lost a word.

    found None: no run of the text repeats.
    """
    if not text:
        return text, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    places = word_places(data)
    at, ends = borders(data, *places)
    if found is None or not len(ends):
        return text, max(1, len(ends)), 0
    words = word_hashes(data, *places)
    starts, stops, _ = runs(words, ends, p)
    h = _string_hashes(prefixes(words), starts, stops)
    gone = np.zeros(len(words) + 1, np.int64)
    order = np.argsort(starts, kind="stable")
    kept, first, of = np.unique(h[order], return_index=True, return_inverse=True)
    place = np.empty(len(order), np.int64)
    place[order] = of  # of each run, the place of its hash
    earlier = np.zeros(len(kept), bool)
    earlier[place[[k for k in found if k >= 0]]] = True
    end = stops[order][first]
    at_once = np.flatnonzero(earlier[place] | (starts >= end[place]))
    np.add.at(gone, starts[at_once], 1)
    np.add.at(gone, stops[at_once], -1)
    covered = np.cumsum(gone)[:-1] > 0
    if not covered.any():
        return text, len(ends), 0
    turns = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
    left = b"".join(data[at[i] : at[j]] for i, j in zip(turns[::2], turns[1::2], strict=True))
    lost = np.add.reduceat(covered.astype(np.int64), np.concatenate([[0], ends[:-1]]))
    return left.decode("utf-8", "surrogatepass"), len(ends), int((lost > 0).sum())


def remove_repeated_spans(docs: DataFrame, params: SpanParams = SpanParams()) -> DataFrame:
    """The rows of docs with repeated spans cut from text, and n_sentences, n_removed (long): sentences, and those that lost words.

    n_chars, where there is one, is that of the new text where something was removed, else as it was. A null text stays null and an empty
    one empty, with 0 sentences; a text all of whose sentences are repeated becomes empty. Of documents that repeat each other, the one
    with the smallest doc_id keeps its text. Rows of one doc_id count as one document: they lose what others have or what repeats within
    a row, and nothing for each other's sake. A row without doc_id loses only what it repeats itself. An empty table gives an empty result. Columns of docs named n_sentences or n_removed are replaced.
    """
    p = params
    names, counts = docs.drop(*COUNTED).columns, "n_chars" in docs.columns
    fields = T.StructType([*docs.drop(*COUNTED).schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTED]])
    docs = _keyed(docs.drop(*COUNTED))
    found, again = spans(docs, p)
    found = materialize(found, "spans")
    # a run occurs once in a document at most here, so two documents make it a repeated one
    repeated = materialize(found.groupBy("h").agg(F.min(KEY[0]).alias("first"), F.max(KEY[0]).alias("last"), F.count("*").alias("n")).where("first != last").select("h", "first", "n"), "repeated")
    later = join_by_key(found, repeated, "h", "n", "inner").where(F.col(KEY[0]) != F.col("first")).select(*KEY, "at").unionByName(again.select(*KEY, F.lit(_AGAIN).alias("at")))
    later = materialize(later.groupBy(*KEY).agg(F.collect_set("at").alias(CUTS)), "cuts")
    discard(found, repeated, again)
    alone = F.when(F.col("doc_id").isNull(), F.array(F.lit(_AGAIN)))
    marked = docs.join(later, KEY, "left").withColumn(CUTS, F.coalesce(CUTS, alone)).drop(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            done = [cut(t, s, p) for t, s in zip(b.column("text").to_pylist(), b.column(CUTS).to_pylist(), strict=True)]
            cols = {c: b.column(c) for c in names}
            cols["text"] = pa.array([x[0] for x in done], pa.string())
            if counts:
                same = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([len(x[0]) if x[2] else n for x, n in zip(done, same, strict=True)], cols["n_chars"].type)
            for k, c in enumerate(COUNTED, 1):
                cols[c] = pa.array([x[k] for x in done], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    return map_batches(marked, run, fields)
