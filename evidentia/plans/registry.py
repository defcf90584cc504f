"""Dimensions and policy: collections, source classes and their trust, search stages, quotas, boosts, grounding rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Trust tier of each source class, 1 the highest.
TIERS = {"primary_text": 1, "reference_encyclopedia": 2, "peer_reviewed": 3, "curated_bibliography": 4}
HIGH_TRUST = 2


@dataclass(frozen=True)
class Collection:
    label: int
    name: str
    source_class: str
    exposure: str


# Collections of the bundled catalogue; callers may pass their own.
COLLECTIONS = (
    Collection(0, "dialogues", "primary_text", "public"),
    Collection(1, "treatises", "primary_text", "public"),
    Collection(2, "fragments", "primary_text", "public"),
    Collection(3, "letters", "primary_text", "public"),
    Collection(4, "lectures", "primary_text", "public"),
    Collection(5, "encyclopedia_a", "reference_encyclopedia", "public"),
    Collection(6, "encyclopedia_b", "reference_encyclopedia", "local_only"),
    Collection(7, "journals_a", "peer_reviewed", "public"),
    Collection(8, "journals_b", "peer_reviewed", "local_only"),
    Collection(9, "bibliography_a", "curated_bibliography", "public"),
)


@dataclass(frozen=True)
class Policy:
    # Defaults of the retrieval policy.
    max_chunks: int = 5
    threshold: float = 0.30
    stages: tuple[tuple[str, int], ...] = (("primary_text", 10), ("reference_encyclopedia", 10), ("peer_reviewed", 5))
    quotas: tuple[tuple[str, int], ...] = (("primary_text", 1), ("reference_encyclopedia", 1))
    tier_boosts: dict[int, float] = field(default_factory=lambda: {1: 1.30, 2: 1.15, 3: 1.00, 4: 0.90})
    collection_boosts: dict[tuple[str, str], float] = field(default_factory=lambda: {("encyclopedia_a", "orientation"): 1.10})
    direct_min_primary: int = 1
    direct_min_high_trust: int = 2
    low_confidence: float = 0.35


def dimension(spark: SparkSession, collections: tuple[Collection, ...] = COLLECTIONS) -> DataFrame:
    """label, collection, source_class, tier, exposure; a row per collection."""
    rows = [(c.label, c.name, c.source_class, TIERS[c.source_class], c.exposure) for c in collections]
    return spark.createDataFrame(rows, "label int, collection string, source_class string, tier int, exposure string")


DIMENSION_SQL = "coll(label, collection, source_class, tier, exposure) AS (VALUES " + ", ".join(f"({c.label}, '{c.name}', '{c.source_class}', {TIERS[c.source_class]}, '{c.exposure}')" for c in COLLECTIONS) + ")"
