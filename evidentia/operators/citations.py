"""Matching citations with the chunks retrieved for the same question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import location
from evidentia.functions.profile import KINDS, SAMPLE, Vocabulary, off_topic, with_profile
from evidentia.functions.text import strip_marks


def normalize_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(strip_marks(x), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_name(x), r"\bbook\s+[ivxlcdm]+\b", ""), r"\s+", " "))


def _compatible(expected: Column, actual: Column) -> Column:
    """Whether each expected token, an initial or a word, finds its match in order among the actual ones."""

    def step(at: Column, e: Column) -> Column:
        hits = F.filter(F.transform(actual, lambda a, i: F.when((i >= at) & ((a == e) | ((F.least(F.length(a), F.length(e)) == 1) & (F.left(a, F.lit(1)) == F.left(e, F.lit(1))))), i)), lambda i: i.isNotNull())
        return F.when(at < 0, at).when(F.size(hits) > 0, hits[0] + 1).otherwise(-1)

    return F.aggregate(expected, F.lit(0), step) >= 0


def name_score(e: Column, a: Column) -> Column:
    """Of normalized names: 90 equal, 75 expected fits in order, 70 subset, 62 and 60 the other way, else 0."""
    et, at = F.split(e, " "), F.split(a, " ")
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    empty = F.coalesce(e == "", F.lit(True)) | F.coalesce(a == "", F.lit(True))
    return F.when(empty, 0).when(e == a, 90).when(_compatible(et, at), 75).when(inside(et, at), 70).when(_compatible(at, et), 62).when(inside(at, et), 60).otherwise(0)


def title_score(e: Column, a: Column) -> Column:
    """Of normalized titles: 100 equal, 85 part of the actual title, 75 the other way, 70 two or more words all in it, else 0."""
    empty = F.coalesce(e == "", F.lit(True)) | F.coalesce(a == "", F.lit(True))
    words = F.array_distinct(F.split(e, " "))
    return F.when(empty, 0).when(e == a, 100).when(F.contains(a, e), 85).when(F.contains(e, a), 75).when((F.size(words) >= 2) & (F.size(F.array_except(words, F.split(a, " "))) == 0), 70).otherwise(0)


def location_score(at: Column, cited: Column) -> Column:
    """Of a chunk's range (range_form) and a citation's (one of cited_forms): 150 contained, 125 overlapping (10 more if its start is
    contained, else 5 if its end is), null if neither or the chunk has no location."""
    inside = lambda k: location.within(at["start"], at["end"], cited[k], at["start_key"], at["end_key"], cited[f"{k}_key"])
    equal = (cited["raw"] == at["start"]) | ((cited["start"] == cited["end"]) & inside("start")) | ((cited["start"] == at["start"]) & (cited["end"] == at["end"]))
    meets = location.meet(at["start"], at["end"], cited["start"], cited["end"], at["start_key"], at["end_key"], cited["start_key"], cited["end_key"])
    bonus = F.when(inside("start"), 10).when(inside("end"), 5).otherwise(0)
    return F.when(F.coalesce(equal, F.lit(False)), 150).when(F.coalesce(meets, F.lit(False)), 125 + bonus)


#: Columns of a chunk whose phrase in a claim supports it, and how much.
METADATA = {"author": 7, "section_title": 9, "speaker": 12, "interlocutor": 8}


def support_score(v: Vocabulary = SAMPLE) -> Column:
    """How well a chunk (k_ profile and name columns) supports a claim (c_) of a question (q_)."""
    both = lambda p, kind: F.size(F.array_intersect(f"{p}{kind}", f"k_{kind}"))
    score = F.least(both("c_", "tokens") * 4, F.lit(28)) + both("c_", "topics") * 10 + both("c_", "traditions") * 8 + both("c_", "periods") * 6
    score = score + both("q_", "topics") * 4 + both("q_", "traditions") * 3 + both("q_", "periods") * 2
    general = F.arrays_overlap(F.col("q_topics"), F.array(*map(F.lit, v.general_topics)).cast("array<string>")) & (F.size("q_traditions") == 0)
    first = next(iter(v.penalties), "")
    score = score - F.when((F.col("k_collection") == first) & off_topic("q_", "k_", general, v), 10).otherwise(0)
    score = score + F.when(F.size("c_names") == 0, 0).when(F.arrays_overlap("c_names", "k_names"), 8).otherwise(-6)
    score = score - F.when((F.size("c_topics") > 0) & (F.size("k_topics") > 0) & (both("c_", "topics") == 0), 8).otherwise(0)
    for name, weight in METADATA.items():
        said = (F.col(f"k_said_{name}") != "") & F.contains(F.col("c_said"), F.col(f"k_said_{name}"))
        score = score + F.when(F.coalesce(said, F.lit(False)), weight).otherwise(0)
    return score


def match(citations: DataFrame, chunks: DataFrame, v: Vocabulary = SAMPLE) -> DataFrame:
    """Pairs with a positive score: citation_id, chunk_id, score.

    citations: query_id, citation_id, claim, question, work, author, collection, location. chunks: query_id, chunk_id,
    collection, work_title, author, text, system, value, range_end, and section_title, speaker, interlocutor, context_type,
    tradition, period, topic_list where there are any. A pair meets within a question only; profiles, names and locations are
    made once per citation and per chunk. A claim with little support vetoes the pair; a citation without a claim has no support
    to show. A null question has an empty profile.
    """
    cited = with_profile(with_profile(citations, ["claim"], "c_", v), ["question"], "q_", v)
    cited = cited.withColumn("c_title", normalize_title(F.col("work"))).withColumn("c_name", normalize_name(F.col("author"))).withColumn("claimed", F.coalesce(F.col("claim"), F.lit("")) != "")
    cited = cited.withColumn("c_said", normalize_name(F.col("claim"))).withColumn("forms", location.cited_forms(F.col("location"))).drop("claim", "question")
    for name in ("section_title", "speaker", "interlocutor", "context_type"):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast("string"))
    kept = with_profile(chunks, ["work_title", "author", "section_title", "text"], "k_", v, ("speaker", "interlocutor", "context_type"))
    kept = kept.withColumn("k_title", normalize_title(F.col("work_title"))).withColumn("k_name", normalize_name(F.col("author"))).withColumn("place", location.range_form(F.col("system"), F.col("value"), F.col("range_end")))
    said = [normalize_name(F.col(name)).alias(f"k_said_{name}") for name in METADATA]
    kept = kept.select("query_id", "chunk_id", F.col("collection").alias("k_collection"), "k_title", "k_name", "system", "place", *[f"k_{x}" for x in ("tokens", *KINDS)], *said)
    pairs = cited.join(kept, "query_id").withColumn("title", title_score(F.col("c_title"), F.col("k_title"))).withColumn("person", name_score(F.col("c_name"), F.col("k_name")))
    pairs = pairs.withColumn("cited", location.of_system(F.col("forms"), F.col("system"))).withColumn("at", location_score(F.col("place"), F.col("cited")))
    pairs = pairs.withColumn("support", F.when(F.col("claimed"), support_score(v)).otherwise(0))
    has = lambda c: F.col(c).isNotNull()
    veto = (
        (has("collection") & (F.col("collection") != F.col("k_collection"))) | (has("author") & (F.col("person") == 0)) | (~has("collection") & (F.col("title") == 0)) | (has("location") & F.col("at").isNull())
        | (F.col("claimed") & (F.col("support") < 10) & ~has("location")) | (F.col("claimed") & (F.col("support") < 6) & has("collection"))
    )
    total = F.when(has("collection"), 40).otherwise(0) + F.when(has("author"), F.col("person")).otherwise(0) + F.col("title") + F.when(has("location"), F.col("at")).otherwise(0) + F.col("support")
    scored = pairs.withColumn("score", F.when(F.coalesce(veto, F.lit(False)), 0).otherwise(total))
    return scored.where("score > 0").select("query_id", "citation_id", "chunk_id", "score", has("location").alias("located"))


def disambiguate(matches: DataFrame) -> DataFrame:
    """Per citation: chunk_id, score, grounded. Without a location it must be the only match, with one the single best."""
    by = Window.partitionBy("citation_id")
    best = by.orderBy(F.desc("score"), "chunk_id")
    ranked = matches.withColumn("r", F.row_number().over(best)).withColumn("next", F.lead("score").over(best)).withColumn("n", F.count("*").over(by))
    grounded = F.when(F.col("located"), F.coalesce(F.col("next") < F.col("score"), F.lit(True))).otherwise(F.col("n") == 1)
    return ranked.where("r = 1").select("query_id", "citation_id", "chunk_id", "score", grounded.alias("grounded"))
