"""A store of documents, chunks and links that can be written again: rows replace those of the same key, and nothing else changes.

Tables are Parquet, one folder per bucket of a hash of the document's id. An upsert reads and overwrites only the buckets that it
touches (dynamic partition overwrite), all of them as its job commits. Ids are made from content, so that a second run makes the
same ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import chunking, ingest
from evidentia.operators.lineage import stored as kept
from evidentia.sources import manifest

DOCUMENTS = "document_id string, entry_id string, raw_hash string, kind string, collection string, title string, author string, topics array<string>, parser_version string, ingested_at timestamp"
CHUNKS = "document_id string, chunk_index int, text string, token_count int"
LINKS = "entry_id string, document_id string"
#: Table -> its columns, the key of a row, and what its bucket is made of.
TABLES = {"documents": (DOCUMENTS, ["document_id"], "document_id"), "chunks": (CHUNKS, ["document_id", "chunk_index"], "document_id"), "links": (LINKS, ["entry_id"], "entry_id")}
COUNTERS = ("manifest_entries", "existing_entries", "attempted_entries", "ingested_entries", "linked_entries", "total_documents_before", "total_documents_after", "total_chunks_before", "total_chunks_after")


def made_id(*parts: Column) -> Column:
    """An id of 128 bits from what makes the row."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


@dataclass(frozen=True)
class Store:
    """path: a folder that driver and executors share. buckets: folders of each table, for its whole life."""

    spark: SparkSession
    path: str
    buckets: int = 32

    def read(self, name: str) -> DataFrame:
        """The table; without rows if nothing was written yet."""
        schema = TABLES[name][0]
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")

    def upsert(self, name: str, rows: DataFrame, whole: list[str] | None = None) -> None:
        """Put rows in place of those of the same key; with `whole`, of those that are equal in these columns (chunks of a document
        that has fewer now). Of several rows of one key one is taken."""
        schema, key, by = TABLES[name]
        columns = [x.split()[0] for x in schema.split(", ")]
        fresh = kept(rows.dropDuplicates(key).select(*columns, F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("int").alias("bucket")))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return
        held = self.read(name).where(F.col("bucket").isin(touched))
        left = held.join(fresh.select(*(whole or key)).distinct(), whole or key, "left_anti")
        # written apart first, as a job can't overwrite what it reads
        both = kept(left.select(*columns, "bucket").unionByName(fresh))
        both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def count(self, name: str) -> int:
        return self.read(name).count()


def bootstrap(store: Store, entries: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, config: chunking.ChunkConfig = chunking.ChunkConfig(), now: Column | None = None) -> DataFrame:
    """Bring a manifest's entries (entry_id, kind, collection, title, author, topics, raw) into the store; one row of status and counters.

    Entries that are linked to a document already are left alone. Of the others, one whose content is stored, or comes with a smaller
    entry_id in the same batch, is linked to that document; the rest is parsed, cut into chunks and stored. An entry that gives no chunk
    is an error, before anything is written. Null content counts as none. embed: chunks to chunks, for instance with vectors.
    """
    before = {name: store.count(name) for name in TABLES}
    listed = entries.count()
    known = store.read("links").select("entry_id").distinct()
    schema = "status string, " + ", ".join(f"{c} long" for c in COUNTERS)
    if entries.select("entry_id").join(known, "entry_id", "left_anti").isEmpty():
        # nothing to do: no content is read
        counts = (listed, before["links"], 0, 0, 0, before["documents"], before["documents"], before["chunks"], before["chunks"])
        return store.spark.createDataFrame([("noop", *counts)], schema)
    # parsers know documents by number
    raws = kept(ingest.with_hash(entries.join(known, "entry_id", "left_anti"), "raw").withColumn("number", F.monotonically_increasing_id()))
    # whole contents move once, to be parsed; what is judged goes without
    waiting = raws.drop("raw")
    attempted = waiting.count()
    stored = store.read("documents").groupBy("raw_hash").agg(F.min("document_id").alias("stored_id"))
    first = waiting.where("raw_hash is not null").groupBy("raw_hash").agg(F.min("entry_id").alias("first_id"))
    judged = waiting.join(first, "raw_hash", "left").join(stored, "raw_hash", "left")
    judged = kept(judged.withColumn("fresh", F.col("stored_id").isNull() & (F.coalesce("first_id", "entry_id") == F.col("entry_id"))).withColumn("document_id", F.coalesce("stored_id", made_id(F.coalesce("raw_hash", "entry_id")))))
    fresh = judged.where("fresh")
    parsed = kept(raws.select("number", "kind", "collection", "raw").join(fresh.select("number"), "number", "left_semi").withColumnRenamed("number", "document_id"))
    sections = manifest.parse_entries(parsed)
    sections = kept(sections.withColumnRenamed("document_id", "number").join(fresh.select("number", "document_id"), "number"))
    chunks = chunking.chunk(sections, config).drop("section_index")
    chunks = kept(embed(chunks) if embed else chunks)
    empty = [r["entry_id"] for r in fresh.join(chunks.select("document_id").distinct(), "document_id", "left_anti").select("entry_id").limit(5).collect()]
    if empty:
        raise ValueError(f"entries without a chunk: {', '.join(map(str, empty))}")
    versions = sections.groupBy("document_id").agg(F.first("parser_version").alias("parser_version"))
    topics = F.when(F.size("topics") > 0, F.col("topics"))
    documents = fresh.join(versions, "document_id").withColumn("topics", topics).withColumn("ingested_at", F.current_timestamp() if now is None else now)
    # the links come last: an entry without one is tried again
    store.upsert("chunks", chunks, whole=["document_id"])
    store.upsert("documents", documents)
    store.upsert("links", judged.select("entry_id", "document_id"))
    ingested = fresh.count()
    counts = (listed, before["links"], attempted, ingested, attempted - ingested, before["documents"], store.count("documents"), before["chunks"], store.count("chunks"))
    return store.spark.createDataFrame([("bootstrapped", *counts)], schema)
