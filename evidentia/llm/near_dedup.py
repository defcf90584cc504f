"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set holds the distinct runs of `shingle_words` words of its whole text, A-Z lower-cased. Each run is hashed to a
place in a circle of D places (the first permutation). One further permutation of the circle, shifted by 0, 1, 2, ... places,
gives all coordinates of the signature: coordinate k is the smallest permuted value at (place + k) mod D.

Documents with equal sets are one class; a class stands for all its copies from there on. Classes that agree in a whole band
of coordinates are candidates. A link is confirmed on the full sets. Groups are the connected components of the links.

A band's bucket isn't compared pair by pair, for pairs within one component change nothing. First each class is compared with
the smallest class of each of its buckets, and components are formed. Where a bucket still holds several, its largest is the
main one, and the classes outside it are compared with the bucket's members, in blocks of which only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, join_by_key, map_batches, materialize, slices, small

#: Classes of a bucket, and word runs in their sets, that one task compares with as many others, about.
PART, PART_RUNS = 512, 500_000
#: Word runs (columns) that a task multiplies at a time.
_COLUMNS = 8192
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDedupParams:
    """A pair at the threshold 0.8 is missed by all bands with probability (1 - 0.8^6)^40, about 5 in a million.

    num, den: link if den * intersection >= num * union. circle_bits: the circle has 2^circle_bits places.
    """

    shingle_words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 40
    rows: int = 6
    circle_bits: int = 22
    seed: int = 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _circle(bits: int, seed: int, coordinates: int) -> np.ndarray:
    """Row p: the permuted values at places p, p + 1, ... p + coordinates - 1 of the circle."""
    values = np.random.default_rng(seed).permutation(1 << bits).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: coordinates - 1]]), coordinates)


class Shingler:
    """Sets of hashed word runs of whole texts; hashes of words are kept while one batch is worked on."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes. A null text or one without words has none; a shorter one its whole sequence."""
        split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not split:
            return np.zeros(0, np.uint64)
        known = self.words
        for w in set(split).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
        n = min(self.size, len(h))
        run = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            run = _mix((run ^ h[k : len(h) - n + 1 + k]) * _M3)
        return np.unique(run)


def signature(hashes: np.ndarray, p: NearDedupParams) -> np.ndarray:
    """All coordinates of a set that isn't empty."""
    rows = _circle(p.circle_bits, p.seed, p.bands * p.rows)
    places = (_mix(hashes ^ np.uint64(p.seed)) >> np.uint64(64 - p.circle_bits)).astype(np.int64)
    out = rows[places[:1024]].min(axis=0)
    for i in range(1024, len(places), 1024):
        np.minimum(out, rows[places[i : i + 1024]].min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray, p: NearDedupParams) -> np.ndarray:
    part = sig.reshape(p.bands, p.rows).astype(np.uint64)
    h = np.arange(1, p.bands + 1, dtype=np.uint64)
    for r in range(p.rows):
        h = _mix((h ^ part[:, r]) * _M3)
    return h.view(np.int64)


def signatures(docs: DataFrame, p: NearDedupParams) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shingle, bands = Shingler(p.shingle_words), {}
            n, keys, out = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle(text)
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if key and key not in bands:
                    bands[key] = band_hashes(signature(s, p), p)
                n.append(len(s))
                keys.append(key)
                out.append(bands.get(key))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()), "bands": pa.array(out, pa.list_(pa.int64()))})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and the sorted hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shingle = Shingler(size)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "hashes": pa.array([shingle(t).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))})

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, p: NearDedupParams) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("of_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(p.den * shared >= p.num * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached. Nodes without a link are absent.

    Alternating large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour of a node gets the smallest of the node's neighbours, itself included
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours get the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u")
        nodes = stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(nodes.where("u != v").distinct(), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            found.evidentia_path = edges.evidentia_path
            return found
        last = now


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x (rows) with each of y (columns).

    Only members that both sides have are counted, as products of 0/1 matrices over so many of them at a time.
    """
    owner = lambda sets: np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    of_x, of_y, in_x, in_y = np.concatenate(x), np.concatenate(y), owner(x), owner(y)
    both = np.intersect1d(of_x, of_y)
    out = np.zeros((len(x), len(y)), np.int64)
    sides = []
    for values, rows in ((of_x, in_x), (of_y, in_y)):
        column = np.searchsorted(both, values)
        known = np.flatnonzero(column < len(both))
        known = known[both[column[known]] == values[known]]
        order = known[np.argsort(column[known], kind="stable")]
        sides.append((column[order], rows[order]))
    for start in range(0, len(both), _COLUMNS):
        parts = []
        for (column, rows), n in zip(sides, (len(x), len(y)), strict=True):
            i, j = np.searchsorted(column, [start, start + _COLUMNS])
            held = np.zeros((n, min(_COLUMNS, len(both) - start)), np.float32)
            held[rows[i:j], column[i:j] - start] = 1
            parts.append(held)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


def _compare(p: NearDedupParams):
    """Links between the classes that ask (role x) and those of a part of their bucket (role y), for one pair of parts."""

    def run(table: pa.Table) -> pa.Table:
        of = lambda role: table.filter(pc.equal(table.column("role"), role))
        x, y = of("x"), of("y")
        u = v = np.zeros(0, np.int64)
        if x.num_rows and y.num_rows:
            sets = [[s.values.to_numpy() for s in side.column("hashes")] for side in (x, y)]
            n, m = (np.array([len(s) for s in side]) for side in sets)
            shared = shared_counts(*sets)
            linked = p.den * shared >= p.num * (n[:, None] + m[None, :] - shared)
            linked &= x.column("component").to_numpy()[:, None] != y.column("component").to_numpy()[None, :]
            i, j = np.nonzero(linked)
            u, v = x.column("rep").to_numpy()[i], y.column("rep").to_numpy()[j]
        return pa.table({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    return run


def further_links(members: DataFrame, found: DataFrame, sets: DataFrame, p: NearDedupParams) -> DataFrame:
    """Links between different components within a bucket.

    Each class outside the bucket's main component is compared with all of the bucket: a pair of different components has one
    such class. Both sides are dealt by a hash into parts of about PART classes or PART_RUNS word runs, whichever is less; a
    task compares one part with another and returns the links only. Where a bucket has two classes, the star has compared them.
    """
    members = members.join(sets.select(F.col("doc_id").alias("rep"), F.size("hashes").alias("n")), "rep")
    labels = found.withColumnRenamed("node", "rep")
    labelled = members.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    kinds = labelled.groupBy("band", "h", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    mixed = kinds.groupBy("band", "h").agg(F.count("*").alias("kinds"), F.sum("count").alias("size"), F.sum("n").alias("n"), F.max(F.struct("count", "component", "n")).alias("most")).where("kinds > 1 and size > 2")
    parts = lambda count, n: F.greatest(F.ceil(count / F.lit(PART)), F.ceil(n / F.lit(PART_RUNS)))
    mixed = mixed.select("band", "h", F.col("most.component").alias("main"), parts(F.col("size"), F.col("n")).alias("of_y"), parts(F.col("size") - F.col("most.count"), F.col("n") - F.col("most.n")).alias("of_x"))
    rest = materialize(labelled.drop("n").join(mixed, ["band", "h"]).withColumn("u", F.xxhash64("rep")), "mixed")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ["band", "h", "i", "j"]
    x = rest.where("component != main").select("band", "h", F.pmod("u", "of_x").alias("i"), every("of_y").alias("j"), "rep", "component", F.lit("x").alias("role"))
    y = rest.select("band", "h", every("of_x").alias("i"), F.pmod("u", "of_y").alias("j"), "rep", "component", F.lit("y").alias("role"))
    both = x.unionByName(y).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    links = materialize(both.groupBy(key).applyInArrow(_compare(p), "a long, b long").distinct(), "links")
    discard(rest)
    return links


def near_duplicates(docs: DataFrame, params: NearDedupParams = NearDedupParams()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach, itself included; kept marks that document. A null or empty text, or
    one without words, has 0 shingles and is its own component. Rows with equal sets are linked. Other columns are ignored.
    doc_id must not repeat. A row without doc_id is linked with nothing: it has the component of its copies, if any, and isn't
    kept. An empty table gives an empty result.
    """
    p = params
    signed = materialize(signatures(docs, p), "signatures")
    # a class by its smallest document
    classes = materialize(signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "h"))
    stars = banded.groupBy("band", "h").agg(F.min("rep").alias("star"), F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(stars.select("band", "h", "star"), ["band", "h"]), "members")
    pairs = materialize(members.where("rep != star").select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    met = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "met")
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(small(met), "doc_id", "left_semi"), p.shingle_words), "sets")
    links = materialize(verified(pairs, sets, p), "links")
    found = components(links)
    more = further_links(members.drop("star"), found, sets, p)
    discard(members, pairs, sets, links)
    if not more.isEmpty():
        first, found = found, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        discard(first)
    discard(more, met)
    of_class = materialize(classes.select("set_key", "copies", F.col("rep").alias("node")).join(found, "node", "left").select("set_key", "copies", F.coalesce("component", "node").alias("component_id")), "of-class")
    discard(classes, found)
    out = join_by_key(signed.select("doc_id", "n_shingles", "set_key"), of_class, "set_key", "copies")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, params: NearDedupParams = NearDedupParams()) -> DataFrame:
    """The rows of docs without near-duplicates: of each group, the document with the smallest doc_id stays. Rows without doc_id stay."""
    gone = materialize(near_duplicates(docs, params).where("not kept").select("doc_id"), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
