"""Exact nearest chunks without comparing all with all: clusters, the triangle inequality and the k-th best carried along.

Chunks are grouped around centres, a bounded number of them; a cell is a centre's chunks of one class, in parts of a bounded size, with
its radius. A question first visits the cells nearest to it that hold enough chunks. Their k-th best distance bounds all others: only
cells whose centre is no farther than that and the radius are visited, and there only chunks whose distance to the centre is within
the bound of the question's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.lineage import written
from evidentia.operators.search import _matrix, _unit

#: Distances this far apart, relative to the sphere, may be equal but for rounding.
_SLACK = 1e-6


@dataclass(frozen=True)
class PruneParams:
    """centres: as many at most, from a bounded sample of `sample` chunks. rounds: in which they move. part: chunks of a cell at most, about."""

    centres: int = 128
    sample: int = 20_000
    rounds: int = 6
    part: int = 4096
    seed: int = 3


def fit_centres(chunks: DataFrame, p: PruneParams = PruneParams()) -> np.ndarray:
    """Unit vectors that a sample of chunks, those of the least hashes, gathers around; as many numbers as the parameters allow."""
    rows = chunks.where("embedding is not null").orderBy(F.xxhash64("chunk_id", F.lit(p.seed)), "chunk_id").limit(p.sample).select("embedding").toArrow()
    x = _unit(_matrix(rows.column("embedding")).astype(np.float64)) if rows.num_rows else np.zeros((0, 1))
    x = x[~np.isnan(x).any(axis=1)]
    if not len(x):
        return np.zeros((0, 1))
    k = max(1, min(p.centres, int(len(x) ** 0.5 * 2)))
    centres = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(p.rounds):
        near = np.argmax(x @ centres.T, axis=1)
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = x[near == i].mean(axis=0)
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.divide(centres, norm, out=centres, where=norm > 0)
    return centres


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def _placed(df: DataFrame, key: str, extra: list[str], centres: np.ndarray) -> DataFrame:
    """key, extra columns, embedding, centre (the nearest), away (its distance); vectors of no length have none."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"{key} {kinds[key]}, " + "".join(f"{c} {kinds[c]}, " for c in extra) + f"embedding {kinds['embedding']}, centre int, away double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            x = _unit(_matrix(t.column("embedding")).astype(np.float64))
            d = _distance(x, centres)
            d[np.isnan(d)] = np.inf
            near = d.argmin(axis=1)
            away = d[np.arange(len(d)), near]
            lost = ~np.isfinite(away)
            cols = {c: b.column(c) for c in (key, *extra, "embedding")}
            yield pa.RecordBatch.from_pydict(cols | {"centre": pa.array(near.astype(np.int32), mask=lost), "away": pa.array(away, mask=lost)})

    return df.where("embedding is not null").select(key, *extra, "embedding").mapInArrow(run, schema).where("centre is not null")


def _to_centres(questions: DataFrame, centres: np.ndarray) -> DataFrame:
    """query_id, centre, gap: the distance of each question to each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distance(_unit(_matrix(pa.Table.from_batches([b]).column("embedding")).astype(np.float64)), centres)
                ok = ~np.isnan(d).any(axis=1)
                ids = b.column("query_id").to_numpy()[ok]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, len(centres)), pa.int64()), "centre": pa.array(np.tile(np.arange(len(centres), dtype=np.int32), len(ids))), "gap": pa.array(d[ok].ravel())})

    return questions.where("embedding is not null").select("query_id", "embedding").mapInArrow(run, "query_id long, centre int, gap double")


def _visit(k: dict[str, int], by: str):
    """The nearest of a cell's chunks for the questions that visit it, and how many distances that took."""

    def run(questions: pa.Table, chunks: pa.Table) -> pa.Table:
        ids, near, name, sims, tested = [], [], [], [], 0
        if questions.num_rows and chunks.num_rows:
            kind = chunks.column(by)[0].as_py()
            chunk, away = chunks.column("chunk_id").to_numpy(), chunks.column("away").to_numpy()
            order = np.lexsort((chunk, away))
            chunk, away = chunk[order], away[order]
            held = _unit(_matrix(chunks.column("embedding")).astype(np.float64))[order]
            asked = _unit(_matrix(questions.column("embedding")).astype(np.float64))
            gaps, bounds = questions.column("gap").to_numpy(), questions.column("bound").to_numpy()
            for i, q in enumerate(questions.column("query_id").to_pylist()):
                # chunks are as far from the centre as the question, give or take the bound
                first, last = np.searchsorted(away, [gaps[i] - bounds[i] - _SLACK, gaps[i] + bounds[i] + _SLACK])
                tested += int(last - first)
                if last > first:
                    sim = np.round(held[first:last] @ asked[i], 12)  # equal vectors are equally similar
                    top = np.lexsort((chunk[first:last], -sim))[: k[kind]]
                    ids += [q] * len(top)
                    near += chunk[first:last][top].tolist()
                    sims += sim[top].tolist()
                    name += [kind] * len(top)
        n = len(ids)
        # one more row says how many distances there were
        return pa.table({"query_id": pa.array([*ids, None], pa.int64()), "chunk_id": pa.array([*near, tested], pa.int64()), by: pa.array([*name, None], pa.string()), "similarity": pa.array([*sims, None], pa.float64())}).slice(0 if questions.num_rows and chunks.num_rows else n + 1)

    return run


def nearest(chunks: DataFrame, questions: DataFrame, k: dict[str, int], by: str = "source_class", params: PruneParams = PruneParams()) -> tuple[DataFrame, DataFrame]:
    """query_id, chunk_id, by, similarity, rank as search.nearest gives them; and a row with pairs (of questions and chunks) and tested.

    Null and zero vectors match nothing; equal similarities go by chunk_id; a class absent from k is left out. Vectors have one length.
    """
    p = params
    wanted = chunks.where(F.col(by).isin(list(k)))
    centres = fit_centres(wanted, p)
    schema = f"query_id long, chunk_id long, {by} string, similarity double"
    spark = chunks.sparkSession
    if not len(centres):
        return spark.createDataFrame([], schema + ", rank int"), spark.createDataFrame([(0, 0)], "pairs long, tested long")
    most = F.create_map(*[x for name, n in k.items() for x in (F.lit(name), F.lit(n))])
    placed = written(_placed(wanted, "chunk_id", [by], centres))
    sizes = placed.groupBy("centre", by).agg(F.ceil(F.count("*") / p.part).cast("int").alias("parts"))  # as many rows as centres and classes
    # parts are shells by distance from the centre, which prune better than chance, and a large shell several
    dealt = placed.join(F.broadcast(sizes), ["centre", by])
    hot = dealt.where("parts > 1")
    edges = hot.groupBy("centre", by).agg(F.percentile_approx("away", F.array(*[F.lit(i / 16) for i in range(1, 16)]), F.lit(1000)).alias("edges"))
    shell = F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: F.col("away") > e))
    spread = F.pmod(F.xxhash64("chunk_id"), F.greatest(F.lit(1), F.ceil(F.col("parts") / 16).cast("int")))
    celled = written(dealt.join(F.broadcast(edges), ["centre", by], "left").withColumn("part", F.when(F.col("parts") > 1, shell * 1_000_000 + spread).otherwise(0)).drop("edges", "parts"))
    cells = written(celled.groupBy("centre", by, "part").agg(F.count("*").alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer")))
    asked = written(questions.where("embedding is not null").select("query_id", "embedding"))
    gaps = written(_to_centres(asked, centres))
    routes = gaps.join(cells, "centre").withColumn("least", F.greatest(F.lit(0.0), F.col("gap") - F.col("outer"), F.col("inner") - F.col("gap")))
    # first the nearest cells that hold enough
    onward = Window.partitionBy("query_id", by).orderBy(F.col("gap") + F.col("inner"), "centre", "part")
    before = F.coalesce(F.sum("n").over(onward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    routes = written(routes.withColumn("first", before < most[F.col(by)]).select("query_id", "centre", by, "part", "gap", "least", "first"))

    def visited(way: DataFrame) -> DataFrame:
        left = way.join(asked, "query_id")
        left = left.toDF(*left.columns).groupBy("centre", by, "part")
        return written(left.cogroup(celled.groupBy("centre", by, "part")).applyInArrow(_visit(k, by), schema))

    one = visited(routes.where("first").withColumn("bound", F.lit(4.0)))
    place = F.row_number().over(Window.partitionBy("query_id", by).orderBy(F.desc("similarity"), "chunk_id"))
    best = one.where("query_id is not null").withColumn("rank", place)
    worst = best.where(F.col("rank") == most[F.col(by)]).select("query_id", by, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("bound"))
    rest = routes.where("not first").join(worst, ["query_id", by], "left").withColumn("bound", F.coalesce("bound", F.lit(4.0)))
    two = visited(rest.where(F.col("least") <= F.col("bound") + _SLACK))
    both = one.unionByName(two)
    found = both.where("query_id is not null").withColumn("rank", place).where(F.col("rank") <= most[F.col(by)])
    tested = both.where("query_id is null").agg(F.coalesce(F.sum("chunk_id"), F.lit(0)).alias("tested"))
    pairs = placed.agg(F.count("*").alias("chunks")).crossJoin(asked.agg(F.count("*").alias("questions"))).select((F.col("chunks") * F.col("questions")).alias("pairs"))
    return found, pairs.crossJoin(tested)


def skipped(stats: DataFrame) -> Column:
    """The share of pairs without a distance."""
    return 1 - F.col("tested") / F.greatest(F.lit(1), F.col("pairs"))
