"""Marked plain text: `[SECTION title="" location="" speaker="" interlocutor=""]` lines begin sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import scan

VERSION = "markers-1"
# The marker line, with attributes in this order only.
MARKER = r'^\[SECTION(?:\s+title="([^"]*)")?(?:\s+location="([^"]*)")?(?:\s+speaker="([^"]*)")?(?:\s+interlocutor="([^"]*)")?\s*\]'
FIELDS = ("title", "location", "speaker", "interlocutor")


def sections(docs: DataFrame) -> DataFrame:
    """docs (document_id, raw) to sections: document_id, section_index, title, location, speaker, interlocutor, text.

    Text before the first marker is a section without a title; what follows a marker on its line is dropped. An untitled
    section without text is left out. Everything happens within a row: lines are cut at the markers, then rows come out.
    """
    lines = F.split(F.col("raw"), "\n")
    # places of the marker lines, and as many sections and one more, the first without a marker
    marks = F.array_compact(F.transform(lines, lambda x, i: F.when(F.trim(x).rlike(MARKER), i + 1)))
    bounds = F.concat(F.array(F.lit(0)), marks, F.array(F.size(lines) + 1))
    spans = F.transform(F.array(F.struct(lines.alias("lines"), bounds.alias("at"))), lambda s: F.transform(F.sequence(F.lit(1), F.size(s["at"]) - 1), lambda k: F.struct(
        F.get(s["lines"], F.element_at(s["at"], k) - 1).alias("mark"), F.slice(s["lines"], F.element_at(s["at"], k) + 1, F.element_at(s["at"], k + 1) - F.element_at(s["at"], k) - 1).alias("lines"),
    )))[0]
    attribute = lambda s, i: F.nullif(F.regexp_extract(F.coalesce(s["mark"], F.lit("")), MARKER, i), F.lit(""))
    shaped = F.transform(spans, lambda s: F.struct(*[attribute(s, i).alias(f) for i, f in enumerate(FIELDS, 1)], F.trim(F.array_join(s["lines"], "\n"), F.lit(" \n\t\r")).alias("text")))
    kept = F.filter(shaped, lambda s: (s["text"] != "") | s["title"].isNotNull())
    return docs.select("document_id", F.posexplode(kept).alias("section_index", "s")).select("document_id", "section_index", "s.*")


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """document_id (the file's path), block, place, line of text files, however large: Spark reads a large file in blocks, side by side."""
    files = spark.read.option("lineSep", "\n").text(paths)
    return files.select(F.col("_metadata.file_path").alias("document_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def sections_of_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """`sections` for files as lines (document_id, order columns, line), so that a file need not be one row or one task.

    The number of markers so far, and the last one, are carried over ranges of lines (see scan); a section's lines come together only
    to be its text. A null line is an empty one.
    """
    line = F.coalesce("line", F.lit(""))
    marked = F.trim(line).rlike(MARKER)
    rows = lines.select("document_id", *order, F.when(~marked, line).alias("line"), marked.cast("long").alias("is_mark"), F.when(marked, line).alias("mark"))
    placed = scan.running(rows, ["document_id"], order, {"part": scan.total("is_mark"), "under": scan.latest("mark")})
    held = placed.groupBy("document_id", "part").agg(F.max("under").alias("under"), F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct(*order, "line")))).alias("held"))
    attribute = lambda i: F.nullif(F.regexp_extract(F.coalesce("under", F.lit("")), MARKER, i), F.lit(""))
    text = F.trim(F.array_join(F.transform("held", lambda x: x["line"]), "\n"), F.lit(" \n\t\r"))
    shaped = held.select("document_id", "part", *[attribute(i).alias(f) for i, f in enumerate(FIELDS, 1)], text.alias("text"))
    kept = shaped.where((F.col("text") != "") | F.col("title").isNotNull())
    numbered = scan.running(kept, ["document_id"], ["part"], {"section_index": scan.COUNT})
    return numbered.select("document_id", (F.col("section_index") - 1).cast("int").alias("section_index"), *FIELDS, "text")


def location_ref(raw: Column, system: Column) -> Column:
    """struct(system, value, range_end) of a location literal; null where there is none."""
    parts = F.split(F.trim(raw), "\\s*[-\u2013]\\s*", 2)
    return F.when(F.trim(raw) != "", F.struct(F.coalesce(system, F.lit("custom")).alias("system"), parts[0].alias("value"), F.get(parts, 1).alias("range_end")))
