"""Queries of sources, parsing, chunking, ingestion and locations, with SQL for each."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import bpe, location
from evidentia.functions.text import NORMALIZE_SQL, TOKENS_SQL, normalize, normalize_whole, significant_tokens, word_count
from evidentia.operators import chunking, ingest, intervals, lineage, plugins
from evidentia.operators.store import Store, bootstrap
from evidentia.plans.adapter import table
from evidentia.sources import entries, manifest, markers, numbered, tei


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup_in_batch(_docs(spark, sf_dir)).select("doc_id", "raw_hash", "first_id", "status")


def _manifest_and_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents are manifest entries; those with a label are stored already."""
    docs = ingest.with_hash(_docs(spark, sf_dir)).select(F.col("doc_id").alias("entry_id"), "raw_hash", "text")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id")).distinct()
    return docs, docs.join(labelled, "entry_id", "left_semi").withColumn("document_id", F.col("entry_id"))


def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries_, stored = _manifest_and_store(spark, sf_dir)
    return ingest.pending(entries_, stored).select("entry_id")


def link_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries_, stored = _manifest_and_store(spark, sf_dir)
    return ingest.link_by_hash(ingest.pending(entries_, stored), stored)


def bootstrap_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries_, stored = _manifest_and_store(spark, sf_dir)
    waiting = ingest.pending(entries_, stored)
    known = stored.select("raw_hash").distinct().withColumn("known", F.lit(True))
    first = waiting.groupBy("raw_hash").agg(F.min("entry_id").alias("first"))
    judged = waiting.join(known, "raw_hash", "left").join(first, "raw_hash").withColumn("tokens", word_count(F.col("text")))
    status = F.when(F.col("known"), "linked").when(F.col("entry_id") != F.col("first"), "linked").when(F.col("tokens") < 50, "failed").otherwise("ingested")
    return judged.groupBy(status.alias("status")).agg(F.count("*").alias("n_entries"), F.sum("tokens").alias("n_tokens"))


def purge_reingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German documents come again as version 2."""
    stored = _docs(spark, sf_dir).select("doc_id", "lang", F.lit(1).alias("version"), word_count(F.col("text")).alias("n_tokens"))
    return ingest.reingest(stored, stored.where("lang = 'de'").withColumn("version", F.lit(2)), "doc_id")


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("").alias("tradition"), F.lit(None).cast("string").alias("edition"))
    given = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("t"), "toxic").alias("tradition"), F.when(F.col("quality") == 1, "q1").otherwise("").alias("edition"))
    return ingest.merge_metadata(own, given, "doc_id", ["tradition", "edition"])


def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label as a batch, against those with one as what is stored: from raw text to chunks."""
    entries_, stored = _manifest_and_store(spark, sf_dir)
    batch = ingest.pending(entries_, stored).select(F.col("entry_id").alias("doc_id"), "text")
    plain = lambda docs: docs.select("document_id", F.lit(0).alias("section_index"), F.regexp_replace("raw", "\n", " ").alias("text"))
    return ingest.ingest(batch, stored, plain).drop("section_index")


def bootstrap_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs into one store: documents with a label, then all documents, then all again; those of fewer than 50 words have no chunk and stay out."""
    text = F.regexp_replace("text", "\n", " ")
    entries_ = lineage.stored(_docs(spark, sf_dir).where(word_count(F.col("text")) >= 50).select(
        F.col("doc_id").cast("string").alias("entry_id"), F.lit("prepared_text").alias("kind"), F.lit("letters").alias("collection"), F.col("source").alias("title"), F.col("lang").alias("author"), F.array().cast("array<string>").alias("topics"), text.alias("raw")))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("entry_id")).distinct()
    store = Store(spark, f"{lineage.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    runs = [bootstrap(store, e).withColumn("run", F.lit(i)) for i, e in enumerate((entries_.join(labelled, "entry_id", "left_semi"), entries_, entries_), 1)]
    return reduce(DataFrame.unionByName, runs)


def _lines_of(raw: str):
    """A caller's parser: each line that isn't empty is a section, titled by its first word."""
    for line in raw.split("\n"):
        if line.strip(" "):
            yield {"title": line.split(" ")[0], "text": line.strip(" ")}


def caller_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a caller's parser, reranker and extractor."""
    plugins.register_parser(spark, "evidentia_lines", _lines_of)
    found = plugins.parse_with(_docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw")), "evidentia_lines")
    order = Window.partitionBy("document_id").orderBy(F.desc("boosted_score"), "section_index")
    rerank = plugins.Transform("longest first", lambda df: df.withColumn("boosted_score", F.length("text").cast("double")).withColumn("place", F.row_number().over(order)), "document_id long, section_index int, text string", "boosted_score double, place int")
    extract = plugins.Transform("first number", lambda df: df.withColumn("number", F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit(""))), "text string", "number string")
    return extract(rerank(found)).select("document_id", "section_index", "title", "boosted_score", "place", "number")


def parse_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run over documents as entries of three kinds: each by its parser, then cut into chunks, and counted."""
    n = F.col("doc_id")
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", r"[<>&\x00-\x1F]", " "), r"\s+", " "))
    raw = F.when(n % 3 == 0, F.regexp_replace("text", "\n", " ")).when(n % 3 == 1, F.concat(F.lit('<TEI><text><body><milestone unit="section" n="1"/><p>'), flat, F.lit("</p></body></text></TEI>"))).otherwise(F.concat(F.lit("<p>"), flat, F.lit("</p>")))
    docs = _docs(spark, sf_dir).select(n.alias("document_id"), F.element_at(F.array(*map(F.lit, ("prepared_text", "tei_url", "html_file"))), (n % 3 + 1).cast("int")).alias("kind"), raw.alias("raw"))
    found = manifest.parse(docs)
    return manifest.dry_run(docs, found, chunking.chunk(found))


def _entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of five kinds: marked text, a dialogue and a treatise in TEI, and HTML in both dialects."""
    n = F.col("doc_id")
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", r"[<>&\x00-\x1F]", " "), r"\s+", " "))
    docs = _docs(spark, sf_dir).select(n, flat.alias("flat")).select("*", F.split("flat", " ").alias("words"))
    flat, words = F.col("flat"), F.col("words")
    half = F.floor((F.size(words) + 1) / 2).cast("int")
    one, two = F.array_join(F.slice(words, 1, half), " "), F.array_join(F.slice(words, half + 1, F.greatest(F.size(words) - half, F.lit(0))), " ")
    raw = (
        F.when(n % 5 == 0, F.concat(F.lit('[SECTION title="Marked" location="'), n.cast("string"), F.lit('a"]\n'), flat))
        .when(n % 5 == 1, F.concat(F.lit('<TEI><text><body><milestone unit="section" n="1"/><p>'), flat, F.lit("</p></body></text></TEI>")))
        .when(n % 5 == 2, F.concat(F.lit('<TEI><text n="work"><body><div1 type="book" n="2"><milestone unit="chapter" n="3"/><milestone unit="page" n="980"/><milestone unit="line" n="a21"/><p>'), one, F.lit('</p><p><milestone unit="line" n="a30"/>x '), two, F.lit(' <milestone unit="page" n="981"/>y</p></div1></body></text></TEI>')))
        .when(n % 5 == 3, F.concat(F.lit('<html><body><div class="entry-content"><h1>T</h1><h2>1. First</h2><p>x '), one, F.lit("</p><h3>a. Under</h3><p>y "), two, F.lit("</p></div></body></html>")))
        .otherwise(F.concat(
            F.lit('<html><head><meta property="citation_title" content="T"/><meta name="citation_author" content="Last, First"/></head><body><p>no</p><div id="aueditable"><h1>T</h1><div id="pubinfo"><em>First published Mon Jun 9, 2003; substantive revision Mon Jul 14, 2014</em></div><div id="preamble"><p>x '), one,
            F.lit('</p></div><div id="toc"><ul><li>1. Part<ul><li><div>deep</div></li></ul></li></ul><p>no</p></div><h2><a name="1">1. Part</a></h2><h3 id="1.2">1.2 Under</h3><p>y '), two, F.lit('</p><h2><a name="Bib">Bibliography</a></h2><p>no</p></div></body></html>'),
        ))
    )
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (n % 5 + 1).cast("int"))
    kinds, collections = pick("prepared_text", "tei_url", "tei_url", "html_file", "html_url"), pick("letters", "dialogues", "treatises", "encyclopedia_a", "encyclopedia_b")
    return docs.select(n.alias("document_id"), kinds.alias("kind"), collections.alias("collection"), raw.alias("raw"))


def parse_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.parse_entries(_entry_kinds(spark, sf_dir))


def entry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author and revision of the entries of the second dialect."""
    docs = _entry_kinds(spark, sf_dir).where("collection = 'encyclopedia_b'")
    return numbered.sections(docs).groupBy("document_id").agg(F.first("entry_title").alias("title"), F.first("author").alias("author"), F.first("updated").alias("updated"), F.count("*").alias("n_sections"))


def revision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication lines of orders: first and last dates in long or short form, some without a year."""
    day = lambda c, f: F.date_format(c, f)
    changed = F.col("o_orderdate") + F.expr("interval 40 days")
    line = F.concat(F.lit("First published "), day(F.col("o_orderdate"), "MMM d, yyyy"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("; revised "), day(changed, "MMMM d, yyyy"))).when(F.col("o_orderkey") % 3 == 1, "; soon again").otherwise(""))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("In "), F.col("o_orderkey") % 50)).otherwise(line)
    return table(spark, sf_dir, "orders").select("o_orderkey", entries.revision_date(line).alias("revised"))


def _chunked(docs: DataFrame, text) -> DataFrame:
    return chunking.chunk(docs.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("section_index"), text.alias("text"))).drop("section_index")


def chunk_sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(_docs(spark, sf_dir), F.regexp_replace("text", "\n", " "))


def chunk_paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(_docs(spark, sf_dir), F.regexp_replace("text", "\n", "\n\n"))


def _chunk_sql(text: str) -> str:
    return f"""WITH RECURSIVE s AS (SELECT doc_id, trim({text}, E' \\n\\t\\r') AS t FROM documents),
c AS (SELECT doc_id, t, len(regexp_extract_all(t, '\\S+')) AS n, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS par,
  list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sen FROM s),
l AS (SELECT doc_id, CASE WHEN len(par) > 1 THEN par ELSE sen END AS l FROM c WHERE n > 512),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM l),
z AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '\\S+')) AS tok FROM p),
walk AS (SELECT doc_id, i, 0 AS pack, tok AS total FROM z WHERE i = 1
  UNION ALL SELECT z.doc_id, z.i, CASE WHEN walk.total + z.tok > 512 THEN walk.pack + 1 ELSE walk.pack END, CASE WHEN walk.total + z.tok > 512 THEN z.tok ELSE walk.total + z.tok END FROM walk JOIN z ON z.doc_id = walk.doc_id AND z.i = walk.i + 1),
packs AS (SELECT z.doc_id, pack, string_agg(x, E'\\n\\n' ORDER BY z.i) AS text, sum(tok) AS token_count FROM walk JOIN z USING (doc_id, i) GROUP BY z.doc_id, pack),
kept AS (SELECT *, max(pack) OVER (PARTITION BY doc_id) AS last FROM packs),
every AS (SELECT doc_id, pack, text, token_count FROM kept WHERE pack < last OR token_count >= 50 UNION ALL SELECT doc_id, 0, t, n FROM c WHERE n BETWEEN 50 AND 512)
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pack) - 1)::INTEGER AS chunk_index, text, token_count::INTEGER AS token_count FROM every"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = significant_tokens(normalize(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", word_count(F.col("text")).alias("n_tokens"), F.size(tokens).alias("n_significant"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the whole text's normal form, all of Unicode."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(normalize_whole(F.col("text")), 256).alias("normal_sha256"))


def token_counts_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair tokens of each document."""
    return _docs(spark, sf_dir).select("doc_id", bpe.token_count(F.col("text")).alias("n_tokens"))


def chunk_bpe_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents by sentences, bounded in byte-pair tokens."""
    sections = _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(0).alias("section_index"), F.regexp_replace("text", "\n", " ").alias("text"))
    return chunking.chunk(sections, counts=bpe.counter()).drop("section_index")


def html_fallback_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.trim(F.regexp_replace("html", r"\s+", " ")).alias("text"))


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, and the documents' lines as an entry with numbered headings, through the entry parser."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("raw"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[<>&]", " "), r"\s+", " "))), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("<h2>"), i + 1, F.lit(". Part</h2><p>"), x, F.lit("</p>"))), "")
    docs = _docs(spark, sf_dir).where("text is not null").select((-1 - F.col("doc_id")).alias("document_id"), F.concat(F.lit('<html><body><div class="entry-content"><h1>T</h1>'), body, F.lit("</div></body></html>")).alias("raw"))
    return entries.sections(pages.unionByName(docs)).select("document_id", "section_index", "location", "level", F.length("text").alias("n_chars"))


def tei_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a dialogue: two lines of three open a section and go on over another one, the third is a further speech."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[<>&\x00-\x1F]", " "), r"\s+", " "))
    lines = F.filter(F.transform(F.split("text", "\n"), clean), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 2, F.concat(F.lit('<sp><speaker>B.</speaker><p>'), x, F.lit('</p></sp>'))).otherwise(F.concat(F.lit('<milestone unit="section" n="'), i, F.lit('"/><said who="#A"><head>no</head><p>'), x, F.lit('<note>no</note> more <milestone unit="section" n="'), i, F.lit('b"/> and so </p></said>')))), "")
    raw = _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.concat(F.lit('<TEI><text n="t"><body>'), body, F.lit("</body></text></TEI>")).alias("raw"), F.lit("t").alias("text_id"))
    return tei.sections(raw, "dialogue").select("document_id", "section_index", "title", "location", "speaker", "text")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a marker after its first line."""
    first, rest = F.substring_index("text", "\n", 1), F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)")
    marker = F.concat(F.lit('[SECTION title="'), "source", F.lit('" location="'), F.col("doc_id") % 500, F.lit('a" speaker="'), "lang", F.lit('"] dropped'))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.concat_ws("\n", first, marker, rest).alias("raw"))


def marker_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(markers.sections(_marked(spark, sf_dir)))


def marker_sections_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sections from single lines, with the markers carried from range to range of them."""
    lines = _marked(spark, sf_dir).select("document_id", F.posexplode(F.split("raw", "\n")).alias("number", "line"))
    return _shown(markers.sections_of_lines(lines, ["number"]))


def _shown(found: DataFrame) -> DataFrame:
    ref = markers.location_ref(F.col("location"), F.lit("stephanus"))
    return found.select("document_id", "section_index", "title", ref["value"].alias("location"), "speaker", "text")


def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest entries, some of them faulty; the first fault of each."""
    kind = F.element_at(F.array(*map(F.lit, ("prepared_text", "tei_url", "html_url", "html_file", "pdf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    collection = F.when(F.col("n_chars") % 7 == 0, "nowhere").when(F.col("n_chars") % 7 == 1, "encyclopedia_b").otherwise("dialogues")
    rows = _docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id") % 997).alias("entry_id"), kind.alias("kind"), collection.alias("collection"), F.when(F.col("n_chars") % 3 > 0, "x.txt").alias("input_path"), F.when(F.col("n_chars") % 4 > 0, "u").alias("source_url"), F.when(F.col("n_chars") % 5 > 0, "t").alias("text_id"))
    return manifest.validate(rows).select("doc_id", "violation")


def _raw_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    system = F.element_at(F.array(*map(F.lit, ("stephanus", "bekker", "section", "page", "chapter"))), (k % 5 + 1).cast("int"))
    letter = F.char(97 + k % 2)
    raw = F.when(k % 5 == 0, F.concat(k % 500, letter, F.lit(" – "), k % 500 + 2, letter)).when(k % 5 == 1, F.concat(k % 1400, letter, k % 37)).when(k % 5 == 2, F.concat(F.lit("§ "), k % 9, F.lit("."), letter)).when(k % 5 == 3, F.concat(F.lit("pp. "), k % 300, F.lit("-"), k % 300 + k % 7)).otherwise(F.concat(F.lit("Chapter "), k % 60))
    return table(spark, sf_dir, "orders").select("o_orderkey", system.alias("system"), raw.alias("raw"))


def location_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_locations(spark, sf_dir).withColumn("n", location.normalize(F.col("system"), F.col("raw"))).withColumn("b", location.bounds(F.col("n")))
    keys = [F.array_join(location.key(F.col("system"), F.col("b")[i]), ".").alias(n) for i, n in ((0, "start_key"), (1, "end_key"))]
    return rows.select("o_orderkey", "system", F.col("n").alias("normalized"), *keys)


def location_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as page ranges that cite their order's page range: an equi-join, with the range test on top."""
    page = F.lit("page")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).cast("string").alias("a"), (F.col("o_custkey") % 100 + 20).cast("string").alias("b"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_partkey") % 100).cast("string").alias("c"), (F.col("l_partkey") % 100 + F.col("l_suppkey") % 5).cast("string").alias("d"))
    both = items.join(orders, "o_orderkey")
    both = both.withColumn("overlaps", location.overlap(page, F.col("a"), F.col("b"), F.col("c"), F.col("d"))).withColumn("contained", location.contains(page, F.col("a"), F.col("b"), F.col("c")))
    return both.select("o_orderkey", "l_linenumber", "overlaps", "contained", location.display(F.col("c"), F.nullif(F.col("d"), F.col("c"))).alias("shown"))


def _located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as citations, and orders as ranges of chunks, of seven works by four kinds of location; some aren't in order or of no form."""

    def shaped(kind, at, n):
        letter = F.char(97 + at % 5)
        value = F.when(kind == 0, F.concat(at.cast("string"), letter)).when(kind == 1, F.concat(F.lit("p. "), at.cast("string"))).when(kind == 2, F.concat(at.cast("string"), F.lit("."), n.cast("string"))).otherwise(F.concat(F.lit("fr. "), (at % 9999).cast("string")))
        end = F.when(kind == 0, F.concat((at + n).cast("string"), letter)).when(kind == 1, (at + n).cast("string")).when(kind == 2, F.concat(at.cast("string"), F.lit("."), (n + 2).cast("string"))).otherwise(F.lit(None))
        # one in eleven from back to front
        back = (at % 11 == 0) & (kind == 1)
        return F.element_at(F.array(*map(F.lit, ("stephanus", "page", "section", "other"))), kind + 1).alias("system"), F.when(back, F.concat(F.lit("p. "), (at + n).cast("string"))).otherwise(value).alias("value"), F.when(back, at.cast("string")).otherwise(end).alias("range_end")

    k = F.col("l_partkey") * 31 + F.col("l_suppkey") * 17
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 7).alias("work"), *shaped((F.col("l_partkey") % 4).cast("int"), k % 20011, F.col("l_suppkey") % 3))
    k = F.col("o_orderkey") * 13 + F.col("o_custkey")
    held = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("work"), *shaped((F.col("o_orderkey") % 4).cast("int"), k % 20011, F.col("o_custkey") % 4))
    return cited, held


def citation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per citation with any: how many ranges of its work it overlaps, in how many it begins, and the first of them."""
    cited, held = _located(spark, sf_dir)
    found = intervals.totals(cited, held, ["work"], "o_orderkey")
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n_ranges").alias("n_ranges"), F.sum("n_containing").alias("n_containing"), F.min("first_range").alias("first_range"))


QUERIES = {f.__name__: f for f in (citation_ranges, content_dedup, incremental_pending, link_by_hash, bootstrap_counters, purge_reingest, metadata_merge, ingest_batch, bootstrap_store, caller_plugins, parse_dispatch, parse_by_collection, entry_metadata, revision_dates, chunk_sentence_pack, chunk_paragraph_pack, normal_forms, token_counts, token_counts_bpe, chunk_bpe_pack, html_fallback_sections, html_sections, tei_sections, marker_sections, marker_sections_split, manifest_validation, location_keys, location_overlap)}
_FLAT = r"trim(regexp_replace(regexp_replace(text, '[<>&\x00-\x1F]', ' ', 'g'), '\s+', ' ', 'g'))"
_STORE = "st AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), w AS (SELECT doc_id, sha256(text) AS h, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
_SHAPED = "CASE {k} WHEN 0 THEN ({at} * 5 + {at} % 5) WHEN 1 THEN CASE WHEN {at} % 11 = 0 THEN {at} + {n} ELSE {at} END WHEN 2 THEN {at} * 100 + {n} END AS s{i}, CASE {k} WHEN 0 THEN (({at} + {n}) * 5 + {at} % 5) WHEN 1 THEN CASE WHEN {at} % 11 = 0 THEN {at} ELSE {at} + {n} END WHEN 2 THEN {at} * 100 + {n} + 2 END AS e{i}, {at} % 9999 AS f{i}"
ORACLE_SQL = {
    "citation_ranges": f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS work, l_partkey % 4 AS k, (l_partkey * 31 + l_suppkey * 17) % 20011 AS x, l_suppkey % 3 AS n FROM lineitem),
o AS (SELECT o_orderkey, o_custkey % 7 AS work, o_orderkey % 4 AS k, (o_orderkey * 13 + o_custkey) % 20011 AS x, o_custkey % 4 AS n FROM orders),
a AS (SELECT *, {_SHAPED.format(k="k", at="x", n="n", i=1)} FROM l), b AS (SELECT o_orderkey, work, k, {_SHAPED.format(k="k", at="x", n="n", i=2)} FROM o),
p AS (SELECT l_orderkey, l_linenumber, o_orderkey, s2 <= s1 AND s1 <= e2 AS contained FROM a JOIN b ON a.work = b.work AND a.k = b.k AND s1 <= e2 AND s2 <= e1 WHERE a.k < 3 UNION ALL SELECT l_orderkey, l_linenumber, o_orderkey, true FROM a JOIN b ON a.work = b.work AND a.k = b.k AND f1 = f2 WHERE a.k = 3)
SELECT l_orderkey, l_linenumber, count(*) AS n_ranges, count(*) FILTER (contained) AS n_containing, min(o_orderkey) AS first_range FROM p GROUP BY ALL""",
    "content_dedup": "SELECT doc_id, sha256(text) AS raw_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'new' ELSE 'duplicate' END AS status FROM documents",
    "incremental_pending": "SELECT doc_id AS entry_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "link_by_hash": f"WITH {_STORE} SELECT w.doc_id AS entry_id, min(st.doc_id) AS document_id FROM w JOIN st USING (h) GROUP BY w.doc_id",
    "bootstrap_counters": f"WITH {_STORE}, j AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS tokens, h IN (SELECT h FROM st) AS known, min(doc_id) OVER (PARTITION BY h) AS first FROM w) SELECT CASE WHEN known OR doc_id <> first THEN 'linked' WHEN tokens < 50 THEN 'failed' ELSE 'ingested' END AS status, count(*) AS n_entries, sum(tokens)::BIGINT AS n_tokens FROM j GROUP BY 1",
    "ingest_batch": _chunk_sql("replace(text, chr(10), ' ')").replace("FROM documents)", f"FROM (SELECT doc_id, text FROM (WITH {_STORE} SELECT doc_id, text, min(doc_id) OVER (PARTITION BY h) AS first, h IN (SELECT h FROM st) AS known FROM w) WHERE first = doc_id AND NOT known))", 1),
    "parse_dispatch": f"""SELECT d.doc_id AS document_id, CASE WHEN doc_id % 3 = 2 OR trim(regexp_replace(text, '[<>&\\s]', '', 'g')) <> '' THEN 1 ELSE 0 END::BIGINT AS n_sections, coalesce(n, 0) AS n_chunks, CASE WHEN n > 0 THEN 'ready' ELSE 'failed' END AS status FROM documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM (
{_chunk_sql("CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN " + _FLAT + " ELSE '<p>' || " + _FLAT + " || '</p>' END")}) GROUP BY document_id) c ON c.document_id = doc_id""",
    "bootstrap_store": f"""WITH e AS (SELECT doc_id, sha256(replace(text, chr(10), ' ')) AS h, doc_id IN (SELECT doc_id FROM labels) AS a FROM documents WHERE len(regexp_extract_all(text, '\\S+')) >= 50),
c AS (SELECT document_id, count(*) AS n FROM ({_chunk_sql("replace(text, chr(10), ' ')")}) GROUP BY document_id),
g AS (SELECT h, bool_or(a) AS a, any_value(n) AS n FROM e JOIN c ON c.document_id = doc_id GROUP BY h),
t AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM e WHERE a) AS na, count(*) AS g, count(*) FILTER (a) AS ga, sum(n)::BIGINT AS c, coalesce(sum(n) FILTER (a), 0)::BIGINT AS ca FROM g)
SELECT 1 AS run, CASE WHEN na > 0 THEN 'bootstrapped' ELSE 'noop' END AS status, na AS manifest_entries, 0 AS existing_entries, na AS attempted_entries, ga AS ingested_entries, na - ga AS linked_entries, 0 AS total_documents_before, ga AS total_documents_after, 0 AS total_chunks_before, ca AS total_chunks_after FROM t
UNION ALL SELECT 2, 'bootstrapped', n, na, n - na, g - ga, (n - na) - (g - ga), ga, g, ca, c FROM t
UNION ALL SELECT 3, 'noop', n, n, 0, 0, 0, g, g, c, c FROM t""",
    "caller_plugins": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
s AS (SELECT doc_id AS document_id, unnest(range(len(l)))::INTEGER AS section_index, unnest(l) AS x FROM l)
SELECT document_id, section_index, string_split(x, ' ')[1] AS title, length(trim(x))::DOUBLE AS boosted_score, row_number() OVER (PARTITION BY document_id ORDER BY length(trim(x)) DESC, section_index)::INTEGER AS place, nullif(regexp_extract(x, '[0-9]+', 0), '') AS number FROM s""",
    "parse_by_collection": f"""WITH d AS (SELECT doc_id, {_FLAT} AS flat FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, flat, string_split(flat, ' ') AS w FROM d),
h AS (SELECT *, trim(array_to_string(w[1:(len(w) + 1) // 2], ' ')) AS one, trim(array_to_string(w[(len(w) + 1) // 2 + 1:], ' ')) AS two FROM w)
SELECT doc_id AS document_id, 0 AS section_index, 'Marked' AS title, doc_id || 'a' AS location, flat AS text, 'markers-1' AS parser_version FROM h WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 0, '1', '1', flat, 'tei-2' FROM h WHERE doc_id % 5 = 1 AND flat <> ''
UNION ALL SELECT doc_id, 0, 'Book 2, Chapter 3', '980a21', one, 'tei-2' FROM h WHERE doc_id % 5 = 2 AND one <> ''
UNION ALL SELECT doc_id, CASE WHEN one <> '' THEN 1 ELSE 0 END, 'Book 2, Chapter 3', '980a30', trim('x ' || two) || ' y', 'tei-2' FROM h WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, 0, 'First', '1', trim('x ' || one), 'entries-2' FROM h WHERE doc_id % 5 = 3
UNION ALL SELECT doc_id, 1, 'Under', '1.a', trim('y ' || two), 'entries-2' FROM h WHERE doc_id % 5 = 3
UNION ALL SELECT doc_id, 0, 'Preamble', NULL, trim('x ' || one), 'numbered-1' FROM h WHERE doc_id % 5 = 4
UNION ALL SELECT doc_id, 1, 'Under', '1.2', trim('y ' || two), 'numbered-1' FROM h WHERE doc_id % 5 = 4""",
    "entry_metadata": "SELECT doc_id AS document_id, 'T' AS title, 'First Last' AS author, '2014-07-14' AS updated, 2 AS n_sections FROM documents WHERE doc_id % 5 = 4 AND text IS NOT NULL",
    "revision_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'In ' || (o_orderkey % 50) WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS revised FROM orders""",
    "purge_reingest": "SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS version, len(regexp_extract_all(text, '\\S+'))::INTEGER AS n_tokens FROM documents",
    "metadata_merge": "SELECT doc_id, coalesce(CASE WHEN n_chars % 2 = 0 THEN nullif(lang, '') END, 't' || toxic) AS tradition, CASE WHEN quality = 1 THEN 'q1' END AS edition FROM documents LEFT JOIN labels USING (doc_id)",
    "chunk_sentence_pack": _chunk_sql("replace(text, chr(10), ' ')"),
    "chunk_paragraph_pack": _chunk_sql("replace(text, chr(10), chr(10) || chr(10))"),
    "normal_forms": f"SELECT doc_id, sha256({NORMALIZE_SQL.format(x='text')}) AS normal_sha256 FROM documents",
    "token_counts": f"SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INTEGER AS n_tokens, len({TOKENS_SQL.format(x=NORMALIZE_SQL.format(x='text'))})::INTEGER AS n_significant FROM documents",
    "html_fallback_sections": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS text FROM pages",
    "html_sections": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[<>&]', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT -1 - doc_id AS document_id, unnest(range(len(l)))::INTEGER AS section_index, unnest(l) AS x FROM l)
SELECT document_id, section_index, (section_index + 1)::VARCHAR AS location, 1 AS level, length(x)::INTEGER AS n_chars FROM s
UNION ALL SELECT -1 - doc_id, 0, NULL, 0, length('<html><body><div class="entry-content"><h1>T</h1></div></body></html>')::INTEGER FROM l WHERE len(l) = 0
UNION ALL SELECT page_id, 0, NULL, 0, length(trim(regexp_replace(html, '\s+', ' ', 'g')))::INTEGER FROM pages""",
    "tei_sections": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[<>&\x00-\x1F]', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
i AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x, len(l) AS n, l FROM l),
s AS (SELECT doc_id, i * 2 AS o, i::VARCHAR AS location, 'A' AS speaker, 'A: ' || x || ' more' AS text FROM i WHERE i % 3 < 2
UNION ALL SELECT doc_id, i * 2 + 1, i || 'b', CASE WHEN i % 3 = 1 AND i + 1 < n THEN NULL ELSE 'A' END, 'A: and so' || CASE WHEN i % 3 = 1 AND i + 1 < n THEN E'\n\nB: ' || l[i + 2] ELSE '' END FROM i WHERE i % 3 < 2)
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INTEGER AS section_index, location AS title, location, speaker, text FROM s""",
    "marker_sections": """WITH x AS (SELECT *, trim(string_split(text, chr(10))[1], E' \\n\\t\\r') AS first, CASE WHEN contains(text, chr(10)) THEN trim(substr(text, length(string_split(text, chr(10))[1]) + 2), E' \\n\\t\\r') ELSE '' END AS rest FROM documents)
SELECT doc_id AS document_id, 0 AS section_index, NULL::VARCHAR AS title, NULL::VARCHAR AS location, NULL::VARCHAR AS speaker, first AS text FROM x WHERE first <> ''
UNION ALL SELECT doc_id, CASE WHEN first <> '' THEN 1 ELSE 0 END, source, (doc_id % 500) || 'a', lang, rest FROM x""",
    "manifest_validation": """WITH m AS (SELECT doc_id, source || '-' || (doc_id % 997) AS entry_id, ['prepared_text', 'tei_url', 'html_url', 'html_file', 'pdf'][doc_id % 5 + 1] AS kind, n_chars AS n FROM documents)
SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY entry_id) > 1 THEN 'duplicate id' WHEN n % 7 = 0 THEN 'unknown collection' WHEN n % 7 = 1 THEN 'local-only collection' WHEN kind IN ('prepared_text', 'html_file') AND n % 3 = 0 THEN 'no input_path' WHEN kind IN ('tei_url', 'html_url') AND n % 4 = 0 THEN 'no source_url' WHEN kind = 'pdf' THEN 'unknown kind' WHEN kind = 'tei_url' AND n % 5 = 0 THEN 'no text_id' END AS violation FROM m""",
    "location_keys": """WITH r AS (SELECT o_orderkey, o_orderkey AS k, ['stephanus', 'bekker', 'section', 'page', 'chapter'][o_orderkey % 5 + 1] AS system, chr((97 + o_orderkey % 2)::INTEGER) AS ch FROM orders)
SELECT o_orderkey, system, CASE k % 5 WHEN 0 THEN (k % 500) || ch || ' - ' || (k % 500 + 2) || ch WHEN 1 THEN (k % 1400) || ch || (k % 37) WHEN 2 THEN (k % 9) || '.' || ch WHEN 3 THEN (k % 300) || '-' || (k % 300 + k % 7) ELSE (k % 60)::VARCHAR END AS normalized,
CASE k % 5 WHEN 0 THEN (k % 500) || '.' || (k % 2) WHEN 1 THEN (k % 1400) || '.' || (k % 2) || '.' || (k % 37) WHEN 2 THEN '0.' || (k % 9) || '.1.' || (k % 2 + 1) WHEN 3 THEN (k % 300)::VARCHAR ELSE (k % 60)::VARCHAR END AS start_key,
CASE k % 5 WHEN 0 THEN (k % 500 + 2) || '.' || (k % 2) WHEN 1 THEN (k % 1400) || '.' || (k % 2) || '.' || (k % 37) WHEN 2 THEN '0.' || (k % 9) || '.1.' || (k % 2 + 1) WHEN 3 THEN (k % 300 + k % 7)::VARCHAR ELSE (k % 60)::VARCHAR END AS end_key FROM r""",
    "location_overlap": "WITH b AS (SELECT o_orderkey, l_linenumber, o_custkey % 100 AS a, o_custkey % 100 + 20 AS b, l_partkey % 100 AS c, l_partkey % 100 + l_suppkey % 5 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT o_orderkey, l_linenumber, a <= d AND c <= b AS overlaps, a <= c AND c <= b AS contained, CASE WHEN c = d THEN c::VARCHAR ELSE c || '–' || d END AS shown FROM b",
}
ORACLE_SQL["marker_sections_split"] = ORACLE_SQL["marker_sections"]
