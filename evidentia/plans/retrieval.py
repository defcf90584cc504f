"""Queries of retrieval, selection, grounding and access, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.profile import KINDS, SAMPLE, labels_sql, with_profile
from evidentia.functions.text import NORMALIZE_SQL, TOKENS_SQL
from evidentia.operators import pruned, rerank, search
from evidentia.operators.answers import mode_sql, question_mode
from evidentia.operators.guard import leaks, resolve_allowed
from evidentia.plans.adapter import EVERY, SIM_SQL, questions, table, texts, vectors
from evidentia.plans.registry import COLLECTIONS, DIMENSION_SQL, Policy, dimension

POLICY = Policy()
# A lower threshold too, at which early exits happen with unrelated vectors.
LOOSE = Policy(threshold=0.15)
_STAGES = ", ".join(f"('{name}', {i}, {k})" for i, (name, k) in enumerate(POLICY.stages, 1))


def _staged_sql(p: Policy, only: str = "true", boost: str = "1", joined: str = "", extra: str = "") -> str:
    """only: which chunks are searched. boost, joined: a factor of the score and what it needs joined to the candidates."""
    return f"""{SIM_SQL},
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_class ORDER BY similarity DESC, chunk_id) AS rank FROM sim WHERE {only}),
st AS (SELECT cand.*, s.stage, similarity >= {p.threshold} AS above FROM cand JOIN (VALUES {_STAGES}) s(source_class, stage, k) USING (source_class) WHERE rank <= s.k),
runs AS (SELECT *, coalesce(sum(CASE WHEN above AND tier <= 2 THEN 1 ELSE 0 END) OVER w, 0) AS high, coalesce(sum(CASE WHEN above AND tier = 1 THEN 1 ELSE 0 END) OVER w, 0) AS n1, coalesce(sum(CASE WHEN above AND tier = 2 THEN 1 ELSE 0 END) OVER w, 0) AS n2
  FROM st WINDOW w AS (PARTITION BY query_id ORDER BY stage RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
staged AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS returned FROM runs WHERE NOT (high >= {p.max_chunks} AND n1 >= 1 AND n2 >= 1)),
scored AS (SELECT staged.*, {extra} similarity * CASE tier WHEN 1 THEN 1.30 WHEN 2 THEN 1.15 WHEN 3 THEN 1.00 ELSE 0.90 END * {boost} AS score FROM staged {joined} WHERE above),
inclass AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_class ORDER BY score DESC, stage, rank, chunk_id) AS in_class FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN in_class = 1 AND tier = 1 THEN 0 WHEN in_class = 1 AND tier = 2 THEN 1 ELSE 2 END, score DESC, stage, rank, chunk_id) AS position FROM inclass),
selected AS (SELECT * FROM placed WHERE position <= {p.max_chunks})"""


def knn_topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks nearest to the vector of chunk 0: a projection and a top-k, no shuffle of vectors."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    both = vectors(spark, sf_dir).crossJoin(F.broadcast(asked))  # one row
    sim = dot("embedding", "q") / F.nullif(F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("q", "q")), F.lit(0.0))
    return both.select("chunk_id", "collection", sim.alias("similarity")).orderBy(F.desc("similarity"), "chunk_id").limit(10).select("chunk_id", "collection", F.round("similarity", 6).alias("similarity"))


def knn_topk_batch_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = vectors(spark, sf_dir).where(F.col("source_class").isin("primary_text", "peer_reviewed") & F.col("collection").isin("dialogues", "letters", "journals_a"))
    found = search.nearest(chunks, questions(spark, sf_dir), {"primary_text": 10, "peer_reviewed": 5})
    return found.select("query_id", "chunk_id", "source_class", F.round("similarity", 6).alias("similarity"), "rank")


#: Nearest chunks of each class, of a stage without filters.
_KINDS = {"primary_text": 10, "reference_encyclopedia": 10, "peer_reviewed": 5}


def knn_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks of three classes, by clusters and their bounds: exact, without comparing all with all."""
    found, _ = pruned.nearest(vectors(spark, sf_dir), questions(spark, sf_dir), _KINDS)
    return found.select("query_id", "chunk_id", "source_class", F.round("similarity", 6).alias("similarity"), "rank")


def _staged(spark: SparkSession, sf_dir: str, p: Policy) -> DataFrame:
    return search.staged(vectors(spark, sf_dir), questions(spark, sf_dir), p)


def staged_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir, LOOSE).select("query_id", "chunk_id", "stage", "rank", F.round("similarity", 6).alias("similarity"), "above", "returned")


def _scored(spark: SparkSession, sf_dir: str, p: Policy) -> DataFrame:
    dims = F.broadcast(dimension(spark).select("source_class", "tier").distinct())  # four rows
    return rerank.tier_rerank(_staged(spark, sf_dir, p).where("above").join(dims, "source_class"), p)


def tier_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scored(spark, sf_dir, POLICY)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "stage", "rank", "chunk_id"))
    return out.select("query_id", "chunk_id", "tier", F.round("score", 6).alias("score"), order.alias("place"))


def quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.quota_select(_scored(spark, sf_dir, POLICY), POLICY).select("query_id", "position", "chunk_id", "source_class", F.round("score", 6).alias("score"))


def grounding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = search.quota_select(_scored(spark, sf_dir, POLICY), POLICY)
    return search.grounding(questions(spark, sf_dir), selected, POLICY).withColumn("best", F.round("best", 6))


def response_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = search.quota_select(_scored(spark, sf_dir, LOOSE), LOOSE)
    shown = selected.join(vectors(spark, sf_dir).select("chunk_id", "collection", "exposure"), "chunk_id").join(texts(spark, sf_dir), "chunk_id")
    return shown.select("query_id", "position", "chunk_id", "collection", "work_title", "author", F.when(F.col("tier") == 1, "PRIMARY").otherwise("SECONDARY").alias("kind"), (F.col("tier") <= 2).alias("high_trust"), "exposure", F.left("text", F.lit(200)).alias("excerpt"), F.round("score", 6).alias("score"))


def discipline_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles are made once per chunk that some question found, and once per question."""
    found = _staged(spark, sf_dir, LOOSE).where("above").join(vectors(spark, sf_dir).select("chunk_id", "collection", "tier"), "chunk_id")
    docs = texts(spark, sf_dir)
    of_chunk = with_profile(docs.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi"), ["work_title", "author", "text"], "k_").drop("work_title", "author", "text")
    of_query = with_profile(docs.where(F.col("chunk_id") % EVERY == 0), ["text"], "q_").withColumnRenamed("chunk_id", "query_id").drop("work_title", "author", "text")
    both = found.join(of_chunk, "chunk_id").join(of_query, "query_id")
    m = rerank.discipline_multiplier("q_", "k_", F.col("collection"), SAMPLE)
    score = F.col("similarity") * rerank.tier_boost(F.col("tier"), LOOSE) * m
    return both.select("query_id", "chunk_id", F.round(m, 6).alias("multiplier"), F.round(score, 6).alias("score"))


def full_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored by trust, discipline, and collection in the question's mode together."""
    return ranked(spark, sf_dir, LOOSE).select("query_id", "chunk_id", "mode", F.round("score", 6).alias("score"))


def ranked(spark: SparkSession, sf_dir: str, p: Policy, **filters) -> DataFrame:
    """Candidates above the threshold with collection, exposure, tier and the whole score. Profiles are made once per chunk that some
    question found, and once per question; a question without a text has an empty profile."""
    found = search.staged(vectors(spark, sf_dir), questions(spark, sf_dir), p, **filters).where("above").join(vectors(spark, sf_dir).select("chunk_id", "collection", "exposure", "tier"), "chunk_id")
    docs = texts(spark, sf_dir)
    of_chunk = with_profile(found.select("chunk_id").distinct().join(docs, "chunk_id", "left"), ["work_title", "author", "text"], "k_").drop("work_title", "author", "text")
    asked = questions(spark, sf_dir).select("query_id").join(docs.select(F.col("chunk_id").alias("query_id"), "text"), "query_id", "left")
    of_query = with_profile(asked.withColumn("mode", question_mode(F.coalesce("text", F.lit("")))), ["text"], "q_").drop("text")
    return rerank.rerank(found.join(of_chunk, "chunk_id").join(of_query, "query_id"), SAMPLE, p)


def filtered_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of two classes only, over the collections that a public deployment may show."""
    allowed = resolve_allowed([c.name for c in COLLECTIONS if c.exposure == "public"], [], "public", False)
    found = search.staged(vectors(spark, sf_dir), questions(spark, sf_dir), LOOSE, ("reference_encyclopedia", "peer_reviewed"), tuple(allowed))
    return found.select("query_id", "chunk_id", "stage", "rank", F.round("similarity", 6).alias("similarity"), "above", "returned")


def _profile_sql(alias: str, source: str) -> str:
    kinds = ", ".join(f"{labels_sql('n', k)} AS {k}" for k in KINDS)
    return f"{alias} AS (SELECT id, {TOKENS_SQL.format(x='n')} AS tokens, {kinds} FROM ({source}))"


_both = lambda k: f"len(list_intersect(qp.{k}, kp.{k}))"
_some = lambda x, words: f"len(list_intersect({x}, [{', '.join(repr(w) for w in words)}])) > 0"
_ancients = f"({_some('qp.traditions', SAMPLE.ancient_labels)} OR {_some('qp.names', SAMPLE.ancient_names)})"
_aside = f"list_contains(kp.traditions, 'ancient') AND NOT {_ancients} AND ((len(qp.topics) > 0 AND {_both('topics')} = 0) OR {_some('qp.tokens', SAMPLE.general)})"
_multiplier = f"""greatest(0.7, least(1.0 + least({_both('tokens')} * 0.02, 0.12) + {_both('topics')} * 0.06 + {_both('traditions')} * 0.04 + {_both('periods')} * 0.03
  {" ".join(f"- CASE WHEN collection = '{c}' AND {_aside} THEN {v} ELSE 0 END" for c, v in SAMPLE.penalties.items())}
  - CASE WHEN len(qp.traditions) > 0 AND len(kp.traditions) > 0 AND {_both('traditions')} = 0 THEN 0.08 ELSE 0 END
  - CASE WHEN len(qp.periods) > 0 AND len(kp.periods) > 0 AND {_both('periods')} = 0 THEN 0.05 ELSE 0 END, 1.45))"""
_QP = _profile_sql("qp", "SELECT vec_id AS id, " + NORMALIZE_SQL.format(x="coalesce(text, '')") + f" AS n FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % {EVERY} = 0")
_KP = _profile_sql("kp", "SELECT vec_id AS id, " + NORMALIZE_SQL.format(x="coalesce(concat_ws(' ', source, lang, text), '')") + " AS n FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
_MODES = f"modes AS (SELECT vec_id AS id, {mode_sql("coalesce(text, '')")} AS mode FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % {EVERY} = 0)"
_BOOST = f"({_multiplier}::DOUBLE) * CASE {' '.join(f"WHEN collection = '{c}' AND mode = '{m}' THEN {b}" for (c, m), b in LOOSE.collection_boosts.items())} ELSE 1.0 END"
_JOINED = "JOIN qp ON qp.id = query_id JOIN kp ON kp.id = chunk_id JOIN modes ON modes.id = query_id"


def ranked_sql(p: Policy, only: str = "true") -> str:
    """Ends with `selected`: query_id, chunk_id, collection, exposure, tier, score, position."""
    return f"{_QP}, {_KP}, {_MODES}, {_staged_sql(p, only, _BOOST, _JOINED, "mode,")}"


DISCIPLINE_SQL = f"""WITH {_staged_sql(LOOSE)},
{_profile_sql("qp", "SELECT doc_id AS id, " + NORMALIZE_SQL.format(x="text") + f" AS n FROM documents WHERE doc_id % {EVERY} = 0")},
{_profile_sql("kp", "SELECT doc_id AS id, " + NORMALIZE_SQL.format(x="concat_ws(' ', source, lang, text)") + " AS n FROM documents")}
SELECT query_id, chunk_id, round({_multiplier}::DOUBLE, 6) AS multiplier, round((score * {_multiplier})::DOUBLE, 6) AS score FROM scored JOIN qp ON qp.id = query_id JOIN kp ON kp.id = chunk_id"""


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    return docs.groupBy("collection").agg(F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"))


def corpus_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("source_class").agg(F.count("*").alias("n_chunks"), F.countDistinct("collection").alias("n_collections"))


def visible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public collections that hold chunks, per class; classes without any are absent."""
    rows = vectors(spark, sf_dir).where("exposure = 'public'").groupBy("source_class", "tier", "collection").agg(F.count("*").alias("n"))
    return rows.groupBy("source_class", "tier").agg(F.array_join(F.array_sort(F.collect_list("collection")), ",").alias("collections"), F.sum("n").alias("n_chunks"))


def access_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scope of a deployment, with local-only collections on or off: the collections that a request may use, and their chunks."""
    names = {kind: [c.name for c in COLLECTIONS if c.exposure == kind] for kind in ("public", "local_only")}
    rows = [(scope, on, c) for scope in ("public", "internal", "local") for on in (False, True) for c in resolve_allowed(names["public"], names["local_only"], scope, on)]
    allowed = spark.createDataFrame(rows, "scope string, local_only_enabled boolean, collection string")  # a row per scope and collection
    held = vectors(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("n"))
    return allowed.join(held, "collection", "left").groupBy("scope", "local_only_enabled").agg(F.count("*").alias("n_collections"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


def allowlist_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected chunks whose collection a public deployment doesn't allow."""
    allowed = resolve_allowed([c.name for c in COLLECTIONS if c.exposure == "public"], [], "public", False)
    selected = search.quota_select(_scored(spark, sf_dir, LOOSE), LOOSE).join(vectors(spark, sf_dir).select("chunk_id", "collection"), "chunk_id")
    return leaks(selected, allowed).select("query_id", "chunk_id", "collection")


_plain = lambda p, tail: f"WITH {_staged_sql(p)} {tail}"
QUERIES = {f.__name__: f for f in (knn_topk_single, knn_topk_batch_filtered, knn_topk_pruned, staged_retrieval, tier_rerank, quota_select, grounding_levels, response_assembly, discipline_rerank, full_rerank, filtered_retrieval, source_coverage, corpus_health, visible_sources, access_scopes, allowlist_leaks)}
ORACLE_SQL = {
    "knn_topk_single": f"WITH {SIM_SQL} SELECT chunk_id, collection, round(similarity, 6) AS similarity FROM sim WHERE query_id = 0 ORDER BY sim.similarity DESC, chunk_id LIMIT 10",
    "knn_topk_batch_filtered": f"WITH {SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_class ORDER BY similarity DESC, chunk_id) AS rank FROM sim WHERE collection IN ('dialogues', 'letters', 'journals_a')) SELECT query_id, chunk_id, source_class, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= CASE source_class WHEN 'primary_text' THEN 10 ELSE 5 END",
    "access_scopes": f"WITH {DIMENSION_SQL}, s AS (SELECT scope, on_ AS local_only_enabled FROM (VALUES ('public'), ('internal'), ('local')) a(scope), (VALUES (false), (true)) b(on_)), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT scope, local_only_enabled, count(*) AS n_collections, coalesce(sum(n), 0)::BIGINT AS n_chunks FROM s JOIN coll ON exposure = 'public' OR (scope <> 'public' AND local_only_enabled) LEFT JOIN n USING (label) GROUP BY ALL",
    "knn_topk_pruned": f"WITH {SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_class ORDER BY similarity DESC, chunk_id) AS rank FROM sim WHERE source_class <> 'curated_bibliography') SELECT query_id, chunk_id, source_class, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= CASE source_class WHEN 'peer_reviewed' THEN 5 ELSE 10 END",
    "staged_retrieval": _plain(LOOSE, "SELECT query_id, chunk_id, stage, rank::INTEGER AS rank, round(similarity, 6) AS similarity, above, returned FROM staged"),
    "tier_rerank": _plain(POLICY, "SELECT query_id, chunk_id, tier, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY scored.score DESC, stage, rank, chunk_id)::INTEGER AS place FROM scored"),
    "quota_select": _plain(POLICY, "SELECT query_id, position::INTEGER AS position, chunk_id, source_class, round(score, 6) AS score FROM selected"),
    "grounding_levels": _plain(POLICY, """, n AS (SELECT q.query_id, count(chunk_id) FILTER (tier = 1) AS n_primary, count(chunk_id) FILTER (tier = 2) AS n_reference, count(chunk_id) FILTER (tier <= 2) AS n_high_trust, count(chunk_id) AS n_selected, coalesce(max(score), 0.0)::DOUBLE AS best FROM q LEFT JOIN selected ON selected.query_id = q.query_id GROUP BY q.query_id)
SELECT query_id, n_primary, n_reference, n_high_trust, n_selected, round(best, 6) AS best, CASE WHEN n_selected = 0 OR n.best < 0.35 THEN 'low_confidence' WHEN n_primary < 1 OR n_high_trust < 2 THEN 'interpretive' ELSE 'direct' END AS level FROM n"""),
    "response_assembly": _plain(LOOSE, "SELECT query_id, position::INTEGER AS position, chunk_id, collection, source AS work_title, lang AS author, CASE WHEN tier = 1 THEN 'PRIMARY' ELSE 'SECONDARY' END AS kind, tier <= 2 AS high_trust, exposure, left(text, 200) AS excerpt, round(score, 6) AS score FROM selected JOIN documents ON doc_id = chunk_id"),
    "discipline_rerank": DISCIPLINE_SQL,
    "full_rerank": f"WITH {ranked_sql(LOOSE)} SELECT query_id, chunk_id, mode, round(score, 6) AS score FROM scored",
    "filtered_retrieval": f"WITH {_staged_sql(LOOSE, "exposure = 'public' AND source_class <> 'primary_text'")} SELECT query_id, chunk_id, stage, rank::INTEGER AS rank, round(similarity, 6) AS similarity, above, returned FROM staged",
    "source_coverage": f"WITH {DIMENSION_SQL} SELECT collection, count(*) AS n_documents, count(DISTINCT source) AS n_sources FROM embeddings JOIN coll USING (label) JOIN documents ON doc_id = vec_id GROUP BY collection",
    "corpus_health": f"WITH {DIMENSION_SQL} SELECT source_class, count(*) AS n_chunks, count(DISTINCT collection) AS n_collections FROM embeddings JOIN coll USING (label) GROUP BY source_class",
    "visible_sources": f"WITH {DIMENSION_SQL} SELECT source_class, tier, string_agg(DISTINCT collection, ',' ORDER BY collection) AS collections, count(*) AS n_chunks FROM embeddings JOIN coll USING (label) WHERE exposure = 'public' GROUP BY source_class, tier",
    "allowlist_leaks": _plain(LOOSE, "SELECT query_id, chunk_id, collection FROM selected WHERE exposure <> 'public'"),
}
