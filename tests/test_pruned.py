"""Pruned search against the search of all pairs."""

import numpy as np

from evidentia.operators import pruned, search

KINDS = {"a": 4, "b": 7}


def rows(seed, n, spread, dim=8, clusters=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    x = centres[r.integers(0, clusters, n)] + r.normal(size=(n, dim)) * spread
    return [(i, "abc"[int(k)], v.tolist()) for i, (k, v) in enumerate(zip(r.integers(0, 3, n), x))]


def both(spark, held, asked, p=pruned.PruneParams(centres=24, part=40)):
    chunks = spark.createDataFrame(held, "chunk_id long, source_class string, embedding array<double>")
    questions = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    found, stats = pruned.nearest(chunks, questions, KINDS, params=p)
    key = lambda df: sorted((r.query_id, r.source_class, r["rank"], r.chunk_id, round(r.similarity, 9)) for r in df.collect())
    return key(found), key(search.nearest(chunks, questions, KINDS)), stats.first()


def test_same_rows_and_most_pairs_skipped(spark):
    """Clustered vectors with nulls, zero vectors, a class that isn't asked for, and a third of all rows equal."""
    held = rows(1, 3000, 0.05)
    held = [(i, k, held[0][2] if i % 3 == 0 else v) for i, k, v in held] + [(9001, "a", None), (9002, "a", [0.0] * 8)]
    asked = [(i, held[i][2]) for i in range(1, 600, 20)] + [(9001, None), (9002, [0.0] * 8)]
    found, exact, stats = both(spark, held, asked)
    assert found == exact and len(found) == 30 * 11
    assert stats.tested < 0.5 * stats.pairs


def test_same_rows_where_nothing_can_be_skipped(spark):
    held = rows(2, 400, 3.0, dim=32)
    found, exact, stats = both(spark, held, [(i, held[i][2]) for i in range(0, 400, 40)])
    assert found == exact and stats.tested <= stats.pairs


def test_few_or_no_rows(spark):
    held = rows(3, 5, 1.0)
    found, exact, _ = both(spark, held, [(0, held[0][2])])
    assert found == exact
    assert both(spark, held[:0], [(0, held[0][2])])[0] == [] == both(spark, held, [])[0]
