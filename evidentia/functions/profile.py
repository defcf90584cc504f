"""Subject profiles of texts from a vocabulary that the caller supplies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import contains_phrase, normalize, significant_tokens


@dataclass(frozen=True)
class Vocabulary:
    """topics, traditions, periods: label -> phrases. philosophers: name -> labels (kind, label) that it adds. general: words
    of questions about the field at large, and general_topics topics of such questions. penalties: collection -> what a mismatch
    costs. ancient_labels, ancient_names: traditions and names by which a question asks for the ancients.

    strict_phrases: phrases of several words are looked up with their spaces; otherwise with underscores, as labels are written.
    """

    topics: dict[str, tuple[str, ...]]
    traditions: dict[str, tuple[str, ...]]
    periods: dict[str, tuple[str, ...]]
    philosophers: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    general: tuple[str, ...] = ("philosophy", "ethics", "metaphysics", "epistemology", "mind", "language", "logic", "consciousness", "knowledge")
    general_topics: tuple[str, ...] = ("ethics", "metaphysics", "epistemology", "philosophy_of_mind", "philosophy_of_language", "logic")
    penalties: dict[str, float] = field(default_factory=lambda: {"dialogues": 0.18, "treatises": 0.12})
    ancient_labels: tuple[str, ...] = ("ancient", "classical")
    ancient_names: tuple[str, ...] = ()
    strict_phrases: bool = False


# A vocabulary over the words of the bundled tables.
SAMPLE = Vocabulary(
    topics={"virtue": ("than", "thing"), "mind": ("hand", "heer"), "justice": ("stand", "ering"), "form": ("queau", "geist")},
    traditions={"ancient": ("eron", "ated"), "modern": ("oner", "anti"), "medieval": ("enter",)},
    periods={"ancient": ("aten",), "modern": ("tional", "ness"), "late": ("esen",)},
    philosophers={"athe": (("traditions", "ancient"), ("topics", "form")), "ouaux": (("traditions", "modern"),)},
    general_topics=("mind", "form"),
    ancient_names=("athe",),
)
KINDS = ("topics", "traditions", "periods", "names")


def labels(normalized: Column, kind: str, v: Vocabulary) -> Column:
    """Distinct labels whose phrases the normalized text contains."""
    found = []
    written = lambda p: p if v.strict_phrases else p.replace(" ", "_")
    if kind == "names":
        return F.array_compact(F.array(*[F.when(contains_phrase(normalized, written(name)), F.lit(name)) for name in v.philosophers]).cast("array<string>"))
    for label, phrases in getattr(v, kind).items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | contains_phrase(normalized, written(p))
        found.append(F.when(hit, F.lit(label)))
    for name, adds in v.philosophers.items():
        found += [F.when(contains_phrase(normalized, written(name)), F.lit(label)) for k, label in adds if k == kind]
    return F.array_distinct(F.array_compact(F.array(*found)))


def with_profile(df: DataFrame, parts: list[str], prefix: str, v: Vocabulary = SAMPLE, more_tokens: tuple[str, ...] = ()) -> DataFrame:
    """df with prefix + tokens, topics, traditions, periods, names of the joined parts; tokens of more_tokens too.

    Where df has them, the columns tradition, period (strings) and topic_list (array) add labels of their own.
    """
    text = normalize(F.concat_ws(" ", *parts))
    out = df.withColumn("evidentia_norm", text)
    own, new = {"traditions": "tradition", "periods": "period"}, {}
    for kind in KINDS:
        found = labels(F.col("evidentia_norm"), kind, v)
        if own.get(kind) in df.columns:
            found = F.array_distinct(F.concat(found, F.array_compact(F.array(F.nullif(F.col(own[kind]), F.lit(""))))))
        if kind == "topics" and "topic_list" in df.columns:
            found = F.array_distinct(F.concat(found, F.filter(F.transform(F.coalesce("topic_list", F.array().cast("array<string>")), lambda x: F.replace(normalize(x), F.lit(" "), F.lit("_"))), lambda x: x != "")))
        new[prefix + kind] = found
    said = F.col("evidentia_norm") if not more_tokens else normalize(F.concat_ws(" ", *parts, *more_tokens))
    return out.withColumns(new | {prefix + "tokens": significant_tokens(said)}).drop("evidentia_norm")


def asks_ancients(q: str, v: Vocabulary) -> Column:
    """Whether the profile with prefix q is explicitly about the ancients."""
    of = lambda kind, xs: F.arrays_overlap(F.col(q + kind), F.array(*map(F.lit, xs)).cast("array<string>"))
    return of("traditions", v.ancient_labels) | of("names", v.ancient_names)


def off_topic(q: str, k: str, general: Column, v: Vocabulary) -> Column:
    """An ancient text for a question that isn't about the ancients, and is about other topics or the field at large."""
    other = (F.size(f"{q}topics") > 0) & ~F.arrays_overlap(f"{q}topics", f"{k}topics")
    return F.array_contains(f"{k}traditions", "ancient") & ~asks_ancients(q, v) & (other | general)


def labels_sql(x: str, kind: str, v: Vocabulary = SAMPLE) -> str:
    def hit(p: str) -> str:
        return f"regexp_matches(' ' || {x} || ' ', '[^\\p{{L}}\\p{{N}}_]{p.replace(' ', '_')}[^\\p{{L}}\\p{{N}}_]')"

    if kind == "names":
        return f"list_filter([{', '.join(f"CASE WHEN {hit(n)} THEN '{n}' END" for n in v.philosophers)}], lambda y: y IS NOT NULL)"

    cases = [f"CASE WHEN {' OR '.join(map(hit, phrases))} THEN '{label}' END" for label, phrases in getattr(v, kind).items()]
    cases += [f"CASE WHEN {hit(name)} THEN '{label}' END" for name, adds in v.philosophers.items() for k, label in adds if k == kind]
    return f"list_distinct(list_filter([{', '.join(cases)}], lambda y: y IS NOT NULL))"
