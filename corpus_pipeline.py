"""A pipeline from raw documents to encoded training text: each stage is one operator of evidentia.llm.

Documents with a null or empty text, or one without a letter, go in the first stage, as do texts in no learned language; equal
texts keep the smallest doc_id; null languages and sources are leaves of their own in the mixture. A text that repeats another's
passages throughout may become empty and is then encoded as no ids, if the mixture takes it. Further columns are carried along. doc_id must be
unique; rows without one are never duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import language_id, mixing, near_dedup, queries, sentencepiece_scan, substring_dedup
from evidentia.llm.common import is_held_out, materialize, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Score below which the language counts as unknown.
LEAST_SCORE = 0.5
#: 80 % of the tokens, each document once at most.
MIX = mixing.MixParams(levels=("evidentia_domain", "lang", "source"), weights=queries.MIX_WEIGHTS | {"evidentia_domain": queries.MIX_WEIGHTS["domain"]}, budget_percent=80, max_epochs=1)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model names; those without a letter, or of doubtful language, go."""
    model = language_id.fit(docs.where(~is_held_out()))
    scored = language_id.predict(docs, model, ("evidentia_lang", "evidentia_score"))
    return scored.where((F.col("evidentia_lang") != "und") & (F.col("evidentia_score") >= LEAST_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word runs are alike by 0.8 or more."""
    return near_dedup.keep_one(docs)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of sentences that an earlier one has."""
    return substring_dedup.remove_repeated_spans(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the token budgets of domains, languages and sources choose."""
    named = docs.withColumn("evidentia_domain", F.expr(queries.DOMAIN))
    return mixing.select_mixture(named, MIX).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each document."""
    return sentencepiece_scan.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_identified),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_spans),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Language models, MinHash and Viterbi can't be said in SQL; tests/llm/test_llm_pipeline.py has plain versions of all stages in a row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
