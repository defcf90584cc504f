"""The registered queries of this subpackage: each applies one operator to whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import fertility, fingerprint, html_extract, language_id, license_scan, mixing, near_dedup, personal_data, prefix_trie, pu_quality, sentencepiece_scan, spelling, substring_dedup
from evidentia.llm.common import read_table
from evidentia.llm.oracle import ORACLE_SQL  # noqa: F401


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), near_dedup.NearDedupParams(shingle_words=2))


def op1_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read_table(spark, sf_dir, "documents"))


#: documents have no domain; their sources are spread over three by a hash.
DOMAIN = "case when substr(md5(coalesce(source, '')), 1, 1) < '6' then 'web' when substr(md5(coalesce(source, '')), 1, 1) < 'b' then 'forum' else 'reference' end"
MIX_WEIGHTS = {"domain": {"web": 5, "forum": 2, "reference": 3}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN))
    return mixing.mix(docs, mixing.MixParams(weights=MIX_WEIGHTS))


def op4_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("matches")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_fertility": op1_token_fertility,
    "op4_sentencepiece_scan": op4_sentencepiece_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_html_extraction": op7_html_extraction,
    "op8_license_scan": op8_license_scan,
    "op2_source_mixture": op2_source_mixture,
    "op3_language_id": op3_language_id,
    "op9_pu_quality": op9_pu_quality,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_personal_data": op12_personal_data,
    "op13_prefix_trie": op13_prefix_trie,
}
