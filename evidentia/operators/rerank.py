"""Scores of retrieved chunks: trust tier, collection and question mode, discipline profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.profile import Vocabulary, off_topic
from evidentia.plans.registry import Policy


def tier_boost(tier: Column, policy: Policy) -> Column:
    out = F.lit(1.0)
    for t, b in policy.tier_boosts.items():
        out = F.when(tier == t, F.lit(b)).otherwise(out)
    return out


def collection_boost(collection: Column, mode: Column, policy: Policy) -> Column:
    out = F.lit(1.0)
    for (name, m), b in policy.collection_boosts.items():
        out = F.when((collection == name) & (mode == m), F.lit(b)).otherwise(out)
    return out


def discipline_multiplier(q: str, c: str, collection: Column, vocabulary: Vocabulary) -> Column:
    """From the profile columns with prefixes q and c (tokens, topics, traditions, periods): 0.7 to 1.45."""
    both = lambda k: F.size(F.array_intersect(f"{q}{k}", f"{c}{k}"))
    some = lambda k: (F.size(f"{q}{k}") > 0) & (F.size(f"{c}{k}") > 0)
    general = F.arrays_overlap(F.col(f"{q}tokens"), F.array(*map(F.lit, vocabulary.general)))
    aside = off_topic(q, c, general, vocabulary)
    m = F.lit(1.0) + F.least(both("tokens") * 0.02, F.lit(0.12)) + both("topics") * 0.06 + both("traditions") * 0.04 + both("periods") * 0.03
    for name, penalty in vocabulary.penalties.items():
        m = m - F.when((collection == name) & aside, F.lit(penalty)).otherwise(0.0)
    m = m - F.when(some("traditions") & (both("traditions") == 0), F.lit(0.08)).otherwise(0.0) - F.when(some("periods") & (both("periods") == 0), F.lit(0.05)).otherwise(0.0)
    return F.greatest(F.lit(0.7), F.least(m, F.lit(1.45)))


def rerank(candidates: DataFrame, vocabulary: Vocabulary, policy: Policy = Policy()) -> DataFrame:
    """candidates (similarity, tier, collection, mode, profile columns q_ and k_) with score: similarity times the boosts of trust tier, of
    discipline, and of the collection in the question's mode."""
    boost = tier_boost(F.col("tier"), policy) * discipline_multiplier("q_", "k_", F.col("collection"), vocabulary) * collection_boost(F.col("collection"), F.col("mode"), policy)
    return candidates.withColumn("score", F.col("similarity") * boost)


def tier_rerank(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """candidates (with tier, similarity) and score."""
    return candidates.withColumn("score", F.col("similarity") * tier_boost(F.col("tier"), policy))
