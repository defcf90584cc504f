"""Question modes, prompt contexts, unsupported claims, and scoring of responses against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.profile import SAMPLE, Vocabulary, labels, labels_sql
from evidentia.functions.text import NORMALIZE_SQL, TOKENS_SQL, normalize, significant_tokens

# Phrases by which a question is about a passage, how a question for an overview begins, and words of such a question.
EXEGETICAL = (
    "according to", "what does", "how does", "why does", "where does", "mean by", "argue in", "claim in", "say in", "describe in", "in the meno", "in the republic", "in the apology", "in the phaedo",
    "in the symposium", "in the meditations", "in the enquiry", "in book ", "in chapter ", "in section ", "this passage",
)
ORIENTATION_PREFIXES = ("what is ", "what are ", "who is ", "who are ", "define ", "give an overview of ", "provide an overview of ", "introduce ", "summarize ", "compare ")
ORIENTATION_MARKERS = ("overview", "introduction", "intro", "summary", "survey", "background", "compare", "comparison", "difference", "differences", "define", "definition", "general")


def question_mode(question: Column, v: Vocabulary = SAMPLE) -> Column:
    """default or orientation: a passage phrase anywhere, an overview prefix, an overview word, a word of the field without a named thinker."""
    flat = F.trim(F.regexp_replace(F.lower(question), r"\s+", " "))
    norm = normalize(question)
    tokens = significant_tokens(norm)
    any_of = lambda test, xs: F.exists(F.array(*map(F.lit, xs)), test)
    named = F.size(labels(norm, "names", v)) > 0
    return (
        F.when(any_of(lambda p: F.contains(flat, p), EXEGETICAL), "default")
        .when(any_of(lambda p: F.startswith(flat, p), ORIENTATION_PREFIXES), "orientation")
        .when(F.arrays_overlap(tokens, F.array(*map(F.lit, ORIENTATION_MARKERS))), "orientation")
        .when(F.arrays_overlap(tokens, F.array(*map(F.lit, v.general))) & ~named, "orientation")
        .otherwise("default")
    )


def mode_sql(x: str, v: Vocabulary = SAMPLE) -> str:
    """question_mode in SQL."""
    norm, flat = NORMALIZE_SQL.format(x=x), rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    tokens, words = TOKENS_SQL.format(x=norm), lambda xs: ", ".join(f"'{w}'" for w in xs)
    return f"""CASE WHEN {" OR ".join(f"contains({flat}, '{p}')" for p in EXEGETICAL)} THEN 'default' WHEN {" OR ".join(f"starts_with({flat}, '{p}')" for p in ORIENTATION_PREFIXES)} THEN 'orientation'
WHEN len(list_intersect({tokens}, [{words(ORIENTATION_MARKERS)}])) > 0 THEN 'orientation' WHEN len(list_intersect({tokens}, [{words(v.general)}])) > 0 AND len({labels_sql(norm, "names", v)}) = 0 THEN 'orientation' ELSE 'default' END"""


def prompt_context(selected: DataFrame) -> DataFrame:
    """selected (query_id, position, tier, collection, work_title, author, text) to query_id, context: blocks by trust, then position."""
    head = F.concat(F.lit("["), F.when(F.col("tier") == 1, "PRIMARY").when(F.col("tier") == 2, "REFERENCE").otherwise("SECONDARY"), F.lit("] "), F.concat_ws(", ", "author", "work_title", "collection"))
    block = F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))
    # a question has max_chunks blocks at most
    blocks = F.array_sort(F.collect_list(F.struct("tier", "position", block.alias("block"))))
    return selected.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def messages(contexts: DataFrame, history: DataFrame, system: str) -> DataFrame:
    """query_id, messages: the system's, then the turns of history (query_id, turn, role, text), then question and context."""
    turns = history.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    before = F.transform(F.coalesce("turns", F.array().cast("array<struct<turn:bigint,role:string,text:string>>")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    out = contexts.join(turns, "query_id", "left")
    return out.select("query_id", F.concat(F.array(one("system", F.lit(system))), before, F.array(one("user", F.concat_ws("\n\n", "question", "context")))).alias("messages"))


def unsupported(claims: DataFrame, grounded: DataFrame) -> DataFrame:
    """claims (query_id, claim_pos, claim, n_citations) that cite nothing or none of whose citations is grounded."""
    ok = grounded.where("grounded").select("query_id", "claim_pos").distinct()
    return claims.where("n_citations > 0").join(ok, ["query_id", "claim_pos"], "left_anti").unionByName(claims.where("n_citations = 0"))


def same(a: Column, b: Column) -> Column:
    """Equal but for case and white space."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return flat(a) == flat(b)


def _flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))


def _meets(want: Column, citation: Column) -> Column:
    """Whether a citation is as an expectation (work, author, collection, location, source_class) says; null fields ask for nothing."""
    equal = lambda k: want[k].isNull() | F.coalesce(_flat(citation[k]) == _flat(want[k]), F.lit(False))
    place = lambda x: F.regexp_replace(_flat(x), "[\u2013\u2014\u2212]", "-")
    return equal("work") & (want["author"].isNull() | F.contains(_flat(citation["author"]), _flat(want["author"]))) & equal("collection") & (want["location"].isNull() | (place(citation["location"]) == place(want["location"]))) & (want["source_class"].isNull() | F.coalesce(citation["source_class"] == want["source_class"], F.lit(False)))


def _said(want: Column) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), want[k]) for k in ("work", "author", "collection", "location", "source_class")])


CITATION = "struct<work:string,author:string,collection:string,location:string,source_class:string>"


def judge(cases: DataFrame) -> DataFrame:
    """cases with failures (array of messages) and passed.

    Looks at answer, works, collections, citations (arrays of strings and of CITATION), level, n_citations, n_ungrounded,
    n_unsupported, and expects must_contain, must_not_contain, required_works, any_works, forbidden_works,
    required_collections, forbidden_collections (arrays of strings), required_citations, any_citations (of CITATION),
    allowed_levels, min_citations, max_ungrounded, max_unsupported. A missing column or a null list asks for nothing.
    """
    strings, structs = "array<string>", f"array<{CITATION}>"
    has = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)) if c in cases.columns else F.array().cast(kind)
    answer, works, collections, citations = _flat(F.col("answer")), F.transform(has("works", strings), _flat), F.transform(has("collections", strings), _flat), has("citations", structs)
    said = lambda c, label, bad: F.transform(F.filter(has(c, strings), bad), lambda x: F.concat(F.lit(label), x))
    lists = [
        said("must_contain", "answer lacks: ", lambda x: ~F.contains(answer, _flat(x))), said("must_not_contain", "answer has: ", lambda x: F.contains(answer, _flat(x))),
        said("required_works", "not retrieved: ", lambda x: ~F.array_contains(works, _flat(x))), said("forbidden_works", "retrieved: ", lambda x: F.array_contains(works, _flat(x))),
        said("required_collections", "collection not retrieved: ", lambda x: ~F.array_contains(collections, _flat(x))), said("forbidden_collections", "collection retrieved: ", lambda x: F.array_contains(collections, _flat(x))),
        F.transform(F.filter(has("required_citations", structs), lambda w: ~F.exists(citations, lambda c: _meets(w, c))), lambda w: F.concat(F.lit("not cited: "), _said(w))),
    ]
    some, one = has("any_works", strings), has("any_citations", structs)
    most = lambda count, bound, label: [F.when(F.col(count) > F.col(bound), label)] if bound in cases.columns else []
    single = F.array_compact(F.array(
        F.when((F.size(some) > 0) & ~F.exists(some, lambda x: F.array_contains(works, _flat(x))), F.concat(F.lit("none retrieved of: "), F.array_join(some, ", "))),
        F.when((F.size(one) > 0) & ~F.exists(one, lambda w: F.exists(citations, lambda c: _meets(w, c))), F.concat(F.lit("none cited of: "), F.array_join(F.transform(one, _said), "; "))),
        F.when((F.size(has("allowed_levels", strings)) > 0) & ~F.array_contains(has("allowed_levels", strings), F.col("level")), F.concat(F.lit("level "), "level")),
        F.when(F.col("n_citations") < F.col("min_citations"), "too few citations"), *most("n_ungrounded", "max_ungrounded", "too many ungrounded citations"), *most("n_unsupported", "max_unsupported", "too many unsupported claims"),
    ))
    out = cases.withColumn("failures", F.concat(*lists, single))
    return out.withColumn("passed", F.size("failures") == 0)


CASES = f"id string, question string, mode string, tags array<string>, notes string, expectations struct<must_contain:array<string>,must_not_contain:array<string>,required_works:array<string>,any_works:array<string>,forbidden_works:array<string>,required_collections:array<string>,forbidden_collections:array<string>,required_citations:array<{CITATION}>,any_citations:array<{CITATION}>,allowed_levels:array<string>,min_citations:int,max_ungrounded:int,max_unsupported:int>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A row per case of a JSON file {cases: [...]}, expectations as columns; one citation at least and none ungrounded or unsupported
    unless a case says otherwise. Ids that repeat, expected citations without any field, and negative bounds are errors."""
    cases = spark.read.schema(f"cases array<struct<{CASES.replace(' array', ':array').replace(' string', ':string').replace(' struct', ':struct')}>>").option("mode", "FAILFAST").json(path, multiLine=True)
    flat = cases.select(F.explode("cases").alias("c")).select("c.*").select("*", "expectations.*").drop("expectations")
    flat = flat.na.fill({"min_citations": 1, "max_ungrounded": 0, "max_unsupported": 0})
    # what a set of cases must keep to
    expected = F.concat(*[F.coalesce(F.col(c), F.array().cast(f"array<{CITATION}>")) for c in ("required_citations", "any_citations")])
    loose = F.exists(expected, lambda x: F.coalesce(*[x[f] for f in ("work", "author", "collection", "location", "source_class")]).isNull())
    fault = F.when(F.count("*").over(Window.partitionBy("id")) > 1, "its id is used twice").when(F.col("id").isNull(), "it has none")
    fault = fault.when(loose, "an expected citation names nothing").when(F.least("min_citations", "max_ungrounded", "max_unsupported") < 0, "a bound is negative")
    error = F.raise_error(F.concat(F.lit("case "), F.coalesce("id", F.lit("without id")), F.lit(": "), F.col("fault"))).cast("string")
    return flat.withColumn("fault", fault).withColumn("id", F.when(F.col("fault").isNotNull(), error).otherwise(F.col("id"))).drop("fault")


def write_report(judged: DataFrame, path: str) -> None:
    """JSON lines of the cases and, beside them, of the summary."""
    judged.select("id", "passed", "failures").write.mode("overwrite").json(f"{path}/cases")
    summary(judged.withColumn("all", F.lit("all")), "all").write.mode("overwrite").json(f"{path}/summary")


def with_tags(cases: DataFrame, ids: list[str] | None = None, tags: list[str] | None = None, key: str = "id") -> DataFrame:
    """The cases of these ids that have one of these tags; None asks for nothing."""
    if ids is not None:
        cases = cases.where(F.col(key).isin(*ids))
    if tags is not None:
        cases = cases.where(F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, tags)).cast("array<string>")))
    return cases


def summary(judged: DataFrame, by: str) -> DataFrame:
    return judged.groupBy(by).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"))
