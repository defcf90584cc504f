"""The engine's tables over the raw ones: chunks with collection and trust, questions, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.plans.registry import DIMENSION_SQL, dimension

#: A row in so many is a question.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, embedding, collection, source_class, tier, exposure. The dimension has ten rows."""
    return table(spark, sf_dir, "embeddings").join(F.broadcast(dimension(spark)), "label").withColumnRenamed("vec_id", "chunk_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, embedding: the stated query set."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, work_title, author, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("work_title"), F.col("lang").alias("author"), "text")


SIM_SQL = f"""{DIMENSION_SQL},
emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, v FROM emb WHERE vec_id % {EVERY} = 0),
c AS (SELECT vec_id AS chunk_id, v, collection, source_class, tier, exposure FROM emb JOIN coll USING (label)),
sim AS (SELECT query_id, chunk_id, collection, source_class, tier, exposure, list_cosine_similarity(q.v, c.v) AS similarity FROM q CROSS JOIN c)"""
