"""Ingestion: content hashes, de-duplication against the store, pending entries, links, purges, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.chunking import ChunkConfig, chunk
from evidentia.operators.skew import join_by_key


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("raw_hash", F.sha2(F.col(text).cast("binary"), 256))


def dedup_in_batch(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Per row: status new or duplicate, and first_id: the first row with the same content.

    The first of each hash comes from an aggregate that combines before the shuffle; rows of a much copied content stay where
    they are (see skew). A null text is new.
    """
    hashed = with_hash(docs)
    firsts = hashed.where("raw_hash is not null").groupBy("raw_hash").agg(F.min(order).alias("first_id"), F.count("*").alias("n"))
    out = join_by_key(hashed, firsts, "raw_hash", "n", docs.count()).withColumn("first_id", F.coalesce("first_id", order))
    return out.withColumn("status", F.when(F.col(order) == F.col("first_id"), "new").otherwise("duplicate"))


def ingest(docs: DataFrame, stored: DataFrame, parse, most: int = 512, least: int = 50) -> DataFrame:
    """The whole way of new documents: what isn't stored yet and isn't a copy within the batch is parsed and cut into chunks.

    docs: doc_id, text. stored: raw_hash. parse: documents (document_id, raw) to sections (document_id, section_index, text).
    Chunks of the kept documents: document_id, chunk_index, section_index, text, token_count.
    """
    fresh = dedup_in_batch(docs).where("status = 'new'").join(stored.select("raw_hash").distinct(), "raw_hash", "left_anti")
    return chunk(parse(fresh.select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw"))), ChunkConfig(most, least))


def pending(manifest: DataFrame, stored: DataFrame, key: str = "entry_id") -> DataFrame:
    """Entries whose id isn't stored."""
    return manifest.join(stored.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def link_by_hash(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries (entry_id, raw_hash) whose content is stored already: entry_id and document_id."""
    known = stored.groupBy("raw_hash").agg(F.min("document_id").alias("document_id"))
    return manifest.join(known, "raw_hash").select("entry_id", "document_id")


def purge(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """stored without the rows of these ids."""
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def reingest(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with the fresh rows in place of those with the same key."""
    return purge(stored, fresh, key).unionByName(fresh)


def merge_metadata(chunks: DataFrame, documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field of the chunk, else the document's; an empty string counts as absent."""
    given = documents.select(key, *[F.col(f).alias(f"document_{f}") for f in fields])
    out = chunks.join(given, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f), F.lit("")), F.nullif(F.col(f"document_{f}"), F.lit(""))))
    return out.drop(*[f"document_{f}" for f in fields])


def with_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the embedding of each (document_id, chunk_index); a chunk without one is an error."""
    out = chunks.join(vectors.select("document_id", "chunk_index", "embedding"), ["document_id", "chunk_index"], "left")
    return out.withColumn("embedding", F.coalesce("embedding", F.raise_error(F.concat(F.lit("no embedding for chunk "), F.col("chunk_index"), F.lit(" of "), F.col("document_id")))))


def store(chunks: DataFrame, path: str) -> None:
    """Append chunks to a Parquet table, one folder per source class, so that filters on it read only theirs."""
    chunks.write.mode("append").partitionBy("source_class").parquet(path)
