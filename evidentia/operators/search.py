"""Exact vector search: a stated set of question vectors against all chunks, in blocks, and staged retrieval on top of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.plans.registry import HIGH_TRUST, TIERS, Policy

#: Question vectors, and chunk vectors, that a task holds at a time, the numbers in them, and how many vectors are multiplied at a time.
BLOCK, NUMBERS, TILE = 65_536, 32_000_000, 1024
#: Rows of a part of few chunks, so that all cores have some.
LEAST_PART = 1024


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.full_like(m, np.nan), where=norms > 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column without nulls, all of one length, from its flat buffer."""
    values = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False) if column.num_chunks else np.zeros(0)
    return values.reshape(len(column), -1)


def _best(k: dict[str, int], by: str):
    """The nearest chunks of one part for the questions of one block."""

    def run(questions: pa.Table, chunks: pa.Table) -> pa.Table:
        found = []
        if questions.num_rows and chunks.num_rows:
            ids, chunk, kind = questions.column("query_id").to_numpy(), chunks.column("chunk_id").to_numpy(), np.array(chunks.column(by).to_pylist())
            asked, held = _matrix(questions.column("embedding")), _matrix(chunks.column("embedding"))
            for name, n in k.items():
                at = np.flatnonzero(kind == name)
                at = at[np.argsort(chunk[at], kind="stable")]
                for q in range(0, len(ids) if len(at) else 0, TILE):
                    mine = _unit(asked[q : q + TILE].astype(np.float64))
                    value, place = np.zeros((len(ids[q : q + TILE]), 0)), np.zeros((len(ids[q : q + TILE]), 0), np.int64)
                    for c in range(0, len(at), TILE):
                        here = at[c : c + TILE]
                        sim = mine @ _unit(held[here].astype(np.float64)).T
                        sim[np.isnan(sim)] = -np.inf
                        value, place = np.concatenate([value, sim], axis=1), np.concatenate([place, np.broadcast_to(here, sim.shape)], axis=1)
                        top = np.argsort(-value, axis=1, kind="stable")[:, :n]
                        value, place = np.take_along_axis(value, top, axis=1), np.take_along_axis(place, top, axis=1)
                    i, j = np.nonzero(np.isfinite(value))
                    found.append((ids[q + i], chunk[place[i, j]], np.full(len(i), name, object), value[i, j]))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "chunk_id": pa.array(cols[1], pa.int64()), by: pa.array(cols[2], pa.string()), "similarity": pa.array(cols[3], pa.float64())})

    return run


def nearest(chunks: DataFrame, questions: DataFrame, k: dict[str, int], by: str = "source_class", block: int = BLOCK) -> DataFrame:
    """query_id, chunk_id, by, similarity, rank: per question and class the k[class] chunks with the largest cosine.

    Questions are dealt by a hash into blocks and chunks into parts, of about `block` rows or NUMBERS numbers at most; a task
    multiplies a block with a part tile by tile and passes on the best only, which a window ranks. Neither side passes through the driver. Equal
    similarities go by chunk_id. Null and zero vectors match nothing; a class absent from k is left out.
    """
    wanted = chunks.where(F.col("embedding").isNotNull() & F.col(by).isin(list(k))).select("chunk_id", by, "embedding")
    asked = questions.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("numbers")).first()
    n, cores, block = size["n"], wanted.sparkSession.sparkContext.defaultParallelism, max(1, min(block, NUMBERS // max(1, size["numbers"])))
    parts, blocks = max(1, -(-n // block), min(cores, n // LEAST_PART)), max(1, -(-asked.count() // block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    left = asked.withColumn("block", dealt("query_id", blocks)).withColumn("part", every(parts)).groupBy("block", "part")
    right = wanted.withColumn("part", dealt("chunk_id", parts)).withColumn("block", every(blocks)).groupBy("block", "part")
    found = left.cogroup(right).applyInArrow(_best(k, by), f"query_id long, chunk_id long, {by} string, similarity double")
    most = F.create_map(*[x for name, n in k.items() for x in (F.lit(name), F.lit(n))])
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", by).orderBy(F.desc("similarity"), "chunk_id")))
    return ranked.where(F.col("rank") <= most[F.col(by)])


def staged(chunks: DataFrame, questions: DataFrame, policy: Policy = Policy(), source_filter: tuple[str, ...] = (), collections: tuple[str, ...] | None = None) -> DataFrame:
    """Candidates of the executed stages: query_id, chunk_id, source_class, similarity, rank, stage, above, returned.

    source_filter leaves only stages of these classes, collections only chunks of these collections (None: all). A stage isn't
    executed if the ones before it gave max_chunks results of high trust above the threshold and covered all quotas. above marks
    similarities from the threshold on; returned counts rows of executed stages, whether above or not.
    """
    stages = [(name, i, k) for i, (name, k) in enumerate(policy.stages, 1) if not source_filter or name in source_filter]
    if collections is not None:
        chunks = chunks.where(F.col("collection").isin(*collections))
    stage = F.create_map(*[x for name, i, _ in stages or [("", 0, 0)] for x in (F.lit(name), F.lit(i))])
    found = nearest(chunks, questions, {name: k for name, _, k in stages} or {"": 0}).withColumn("stage", stage[F.col("source_class")]).withColumn("above", F.col("similarity") >= policy.threshold)
    trusted = [name for name, tier in TIERS.items() if tier <= HIGH_TRUST]
    so_far = Window.partitionBy("query_id").orderBy("stage").rangeBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.sum((F.col("above") & F.col("source_class").isin(trusted)).cast("int")).over(so_far), F.lit(0))
    stop = high >= policy.max_chunks
    for name, least in policy.quotas:
        stop = stop & (F.coalesce(F.sum((F.col("above") & (F.col("source_class") == name)).cast("int")).over(so_far), F.lit(0)) >= least)
    run = found.withColumn("stop", stop).where("not stop").drop("stop")
    return run.withColumn("returned", F.count("*").over(Window.partitionBy("query_id")))


def quota_select(ranked: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """ranked (query_id, chunk_id, source_class, stage, rank, score) with position: quota picks first, in the quotas' order, then by score; max_chunks of a question at most."""
    by_score = [F.desc("score"), "stage", "rank", "chunk_id"]
    order = F.create_map(*[x for i, (name, _) in enumerate(policy.quotas) for x in (F.lit(name), F.lit(i))])
    least = F.create_map(*[x for name, n in policy.quotas for x in (F.lit(name), F.lit(n))])
    in_class = F.row_number().over(Window.partitionBy("query_id", "source_class").orderBy(*by_score))
    picked = ranked.withColumn("in_class", in_class).withColumn("quota", F.when(F.col("in_class") <= least[F.col("source_class")], order[F.col("source_class")]).otherwise(F.lit(len(policy.quotas))))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("quota", *by_score))
    return picked.withColumn("position", position).where(F.col("position") <= policy.max_chunks).drop("in_class", "quota")


def grounding(questions: DataFrame, selected: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Per question, those without a result included: n_primary, n_reference, n_high_trust, n_selected, best, level."""
    trusted = [name for name, tier in TIERS.items() if tier <= HIGH_TRUST]
    of = lambda c: F.count_if(c).alias
    counts = selected.groupBy("query_id").agg(
        of(F.col("source_class") == "primary_text")("n_primary"), of(F.col("source_class") == "reference_encyclopedia")("n_reference"),
        of(F.col("source_class").isin(trusted))("n_high_trust"), F.count("*").alias("n_selected"), F.max("score").alias("best"),
    )
    out = questions.select("query_id").join(counts, "query_id", "left").na.fill(0).na.fill(0.0, ["best"])
    level = F.when((F.col("n_selected") == 0) | (F.col("best") < policy.low_confidence), "low_confidence")
    level = level.when((F.col("n_primary") < policy.direct_min_primary) | (F.col("n_high_trust") < policy.direct_min_high_trust), "interpretive").otherwise("direct")
    return out.withColumn("level", level)
