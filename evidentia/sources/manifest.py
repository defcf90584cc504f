"""Manifests of corpus entries: reading, selection, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.plans.registry import COLLECTIONS, TIERS, Collection
from evidentia.sources import entries as entries_html
from evidentia.sources import markers, numbered, tei

SCHEMA = "version string, entries array<struct<id:string,kind:string,collection:string,title:string,author:string,tradition:string,period:string,topics:array<string>,translation:string,edition:string,source_url:string,input_path:string,source_config:map<string,string>>>"
#: Kinds of entries by where their content is.
FILE_KINDS, URL_KINDS = ("prepared_text", "html_file"), ("tei_url", "html_url")


#: What every entry of a manifest has.
REQUIRED = ("id", "kind", "collection", "title", "author")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per entry of a JSON manifest; malformed JSON is an error, as is an entry that lacks one of its required fields, which the error names."""
    found = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path, multiLine=True).select(F.posexplode("entries").alias("at", "e")).select("at", "e.*")
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in REQUIRED]))
    error = F.raise_error(F.concat(F.lit("manifest entry "), F.col("at"), F.lit(" lacks "), F.array_join(lacking, ", "))).cast("string")
    return found.withColumn("id", F.when(F.size(lacking) > 0, error).otherwise(F.col("id"))).drop("at")


def select_entries(entries: DataFrame, ids: list[str] | None, key: str = "id") -> DataFrame:
    """All entries without ids, else those named; unknown ids are ignored."""
    return entries if ids is None else entries.where(F.col(key).isin(ids))


def read_content(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path and raw of UTF-8 files, one row each."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.decode("content", "UTF-8").alias("raw"))


def validate(entries: DataFrame, collections: tuple[Collection, ...] = COLLECTIONS, allow_local_only: bool = False) -> DataFrame:
    """entries (entry_id, kind, collection, input_path, source_url, text_id) with violation: the first rule broken, or null."""
    exposure = F.create_map(*[x for c in collections for x in (F.lit(c.name), F.lit(c.exposure))])
    where = F.try_element_at(exposure, F.col("collection"))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    same = F.count("*").over(Window.partitionBy("entry_id"))
    rule = F.when(same > 1, "duplicate id").when(where.isNull(), "unknown collection")
    if not allow_local_only:
        rule = rule.when(where == "local_only", "local-only collection")
    rule = rule.when(F.col("kind").isin(*FILE_KINDS) & missing("input_path"), "no input_path").when(F.col("kind").isin(*URL_KINDS) & missing("source_url"), "no source_url")
    return entries.withColumn("violation", rule.when(~F.col("kind").isin(*FILE_KINDS, *URL_KINDS), "unknown kind").when((F.col("kind") == "tei_url") & missing("text_id"), "no text_id"))


def metadata(entries: DataFrame, collections: tuple[Collection, ...] = COLLECTIONS) -> DataFrame:
    """Document rows of entries: source class and trust of the collection, empty lists of topics as null, the time of ingestion."""
    dims = entries.sparkSession.createDataFrame([(c.name, c.source_class, TIERS[c.source_class], c.exposure) for c in collections], "collection string, source_class string, tier int, exposure string")
    out = entries.join(F.broadcast(dims), "collection", "left")
    if "topics" in entries.columns:
        out = out.withColumn("topics", F.when(F.size("topics") > 0, F.col("topics")))
    return out.withColumn("ingested_at", F.current_timestamp())


#: Kind of entry -> how its content becomes sections.
PARSERS = {
    "prepared_text": markers.sections,
    "tei_url": lambda docs: tei.sections(docs.withColumn("text_id", F.lit(None).cast("string")) if "text_id" not in docs.columns else docs, "dialogue"),
    "html_file": entries_html.sections,
    "html_url": entries_html.sections,
}


def parse(docs: DataFrame, parsers: dict = PARSERS) -> DataFrame:
    """Sections (document_id, section_index, title, location, text) of docs (document_id, kind, raw) by each kind's parser; an unknown kind is an error."""
    known = docs.withColumn("kind", F.when(F.col("kind").isin(*parsers), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no parser for kind "), F.coalesce("kind", F.lit("null"))))))
    out = None
    for kind, parser in parsers.items():
        found = parser(known.where(F.col("kind") == kind).drop("kind")).select("document_id", "section_index", "title", "location", "text")
        out = found if out is None else out.unionByName(found)
    return out


def _tei(mode: str):
    return lambda docs: tei.sections(docs if "text_id" in docs.columns else docs.withColumn("text_id", F.lit(None).cast("string")), mode)


#: Name of a parser -> its version and what it does.
VERSIONED = {
    "markers": (markers.VERSION, markers.sections),
    "tei_dialogue": (tei.VERSION, _tei("dialogue")),
    "tei_treatise": (tei.VERSION, _tei("treatise")),
    "entries": (entries_html.VERSION, entries_html.sections),
    "numbered": (numbered.VERSION, numbered.sections),
}
#: What a collection's entries are: TEI comes in two modes, HTML in two dialects, and all else is marked text.
TEI_MODES = {"dialogues": "tei_dialogue", "treatises": "tei_treatise"}
DIALECTS = {"encyclopedia_a": "entries", "encyclopedia_b": "numbered"}


def parser_of(kind, collection, tei_modes: dict[str, str] = TEI_MODES, dialects: dict[str, str] = DIALECTS, collections: tuple[Collection, ...] = COLLECTIONS):
    """The parser's name by kind and collection; null where there is none: TEI of another collection, or an unknown collection."""
    chosen = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), collection)
    return F.when(kind == "tei_url", chosen(tei_modes)).otherwise(F.coalesce(chosen(dialects), F.when(collection.isin(*[c.name for c in collections]), F.lit("markers"))))


def parse_entries(docs: DataFrame, parsers: dict = VERSIONED, **tables) -> DataFrame:
    """Sections of docs (document_id, kind, collection, raw, perhaps text_id), each by the parser of its kind and collection, with
    parser_version. An entry for which there is no parser is an error that names it. A null raw has no sections."""
    name = parser_of(F.col("kind"), F.col("collection"), **tables)
    missing = F.raise_error(F.concat(F.lit("no parser for kind "), F.coalesce("kind", F.lit("null")), F.lit(" of collection "), F.coalesce("collection", F.lit("null")))).cast("string")
    named = docs.withColumn("parser", F.coalesce(name, missing)).drop("kind", "collection")
    out = None
    for parser, (version, run) in parsers.items():
        found = run(named.where(F.col("parser") == parser).drop("parser")).select("document_id", "section_index", "title", "location", "text").withColumn("parser_version", F.lit(version))
        out = found if out is None else out.unionByName(found)
    return out


def dry_run(docs: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document of docs: n_sections, n_chunks, status (failed where there is no chunk); nothing is stored."""
    counts = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    out = docs.select("document_id").join(counts(sections, "n_sections"), "document_id", "left").join(counts(chunks, "n_chunks"), "document_id", "left").na.fill(0, ["n_sections", "n_chunks"])
    return out.withColumn("status", F.when(F.col("n_chunks") == 0, "failed").otherwise("ready"))
