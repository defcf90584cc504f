"""Access policy: allowlists of collections, settings checks, leaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.plans.registry import COLLECTIONS, Collection


@dataclass(frozen=True)
class AccessSettings:
    scope: str = "public"
    enable_local_only: bool = False
    public_allowed: str = ""
    local_only_allowed: str = ""


def parse_list(value: str) -> list[str]:
    """Names between commas, trimmed, empty ones dropped."""
    return [x.strip() for x in value.split(",") if x.strip()]


def violations(s: AccessSettings, collections: tuple[Collection, ...] = COLLECTIONS) -> list[str]:
    """What is wrong with the settings, in a fixed order."""
    exposure = {c.name: c.exposure for c in collections}
    public, local = parse_list(s.public_allowed), parse_list(s.local_only_allowed)
    found = []
    if s.scope not in ("public", "internal", "local"):
        found.append(f"unknown deployment scope {s.scope}")
    if unknown := sorted({*public, *local} - set(exposure)):
        found.append(f"unknown collections {', '.join(unknown)}")
    if wrong := sorted(x for x in public if exposure.get(x) == "local_only"):
        found.append(f"local-only collections in the public list: {', '.join(wrong)}")
    if wrong := sorted(x for x in local if exposure.get(x) == "public"):
        found.append(f"public collections in the local-only list: {', '.join(wrong)}")
    if s.scope == "public" and s.enable_local_only:
        found.append("local-only collections can't be enabled in a public deployment")
    return found


def resolve_allowed(public: list[str], local_only: list[str], scope: str, enable_local_only: bool, requested: list[str] | None = None, collections: tuple[Collection, ...] = COLLECTIONS) -> list[str]:
    """Sorted names that a request may use; an unknown or disallowed request is an error."""
    allowed = set(public) | (set(local_only) if scope in ("local", "internal") and enable_local_only else set())
    if not requested:
        return sorted(allowed)
    if unknown := sorted(set(requested) - {c.name for c in collections}):
        raise ValueError(f"unknown collections: {', '.join(unknown)}")
    if barred := sorted(set(requested) - allowed):
        raise ValueError(f"collections not allowed: {', '.join(barred)}")
    return sorted(set(requested))


def leaks(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows with a collection outside the list; a null collection is no leak."""
    return rows.where(F.col("collection").isNotNull() & ~F.col("collection").isin(allowed))
