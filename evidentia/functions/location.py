"""Structured locations (page and column, dotted section, page, chapter): normal form, ordered keys, containment and overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words before a number that mean its kind.
PREFIXES = {"section": r"^(section|sec\.?)\s*", "page": r"^(pages|page|pp\.?|p\.?)\s*", "chapter": r"^(chapters|chapter|chap\.?|ch\.?)\s*"}
_DASHES = "[\u2212\u2014\u2013]"


def normalize(system: Column, raw: Column) -> Column:
    """Trimmed, lower case, one kind of dash and space, without the kind's prefix; null if nothing is left."""
    x = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "\u00a0", " "), _DASHES, "-"), r"\s+", " ")))
    x = F.when(system == "section", F.trim(F.regexp_replace(x, r"^§+\s*", ""))).otherwise(x)
    for name, pattern in PREFIXES.items():
        x = F.when(system == name, F.trim(F.regexp_replace(x, pattern, ""))).otherwise(x)
    return F.nullif(x, F.lit(""))


def bounds(normalized: Column) -> Column:
    """Array of start and end; a single value is both."""
    parts = F.split(normalized, r"\s*-\s*", 2)
    return F.array(parts[0], F.coalesce(F.get(parts, 1), parts[0]))


def key(system: Column, value: Column) -> Column:
    """Array of ints that sorts as the location does; null for what isn't one of the system's forms."""
    number = lambda pattern, g: F.regexp_extract(value, pattern, g).cast("int")
    letter = lambda pattern, g: F.ascii(F.regexp_extract(value, pattern, g)) - 97
    stephanus, bekker = r"^(\d+)([a-e])$", r"^(\d+)([ab])(\d+)?$"
    line = F.regexp_extract(value, bekker, 3)
    alpha = lambda p: F.aggregate(F.split(p, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 96))
    part = lambda p: F.when(p.rlike(r"^\d+$"), F.array(F.lit(0), p.cast("int"))).otherwise(F.array(F.lit(1), alpha(p)))
    return (
        F.when((system == "stephanus") & value.rlike(stephanus), F.array(number(stephanus, 1), letter(stephanus, 2)))
        .when((system == "bekker") & value.rlike(bekker), F.array(number(bekker, 1), letter(bekker, 2), F.when(line == "", 0).otherwise(line.cast("int"))))
        .when((system == "section") & value.rlike(r"^(\d+|[a-z]+)(\.(\d+|[a-z]+))*$"), F.flatten(F.transform(F.split(value, r"\."), part)))
        .when(system.isin("page", "chapter") & value.rlike(r"^\d+$"), F.array(value.cast("int")))
    )


#: Kinds of location that have a form of their own; any other is compared as it is written.
SYSTEMS = ("stephanus", "bekker", "section", "page", "chapter", "")


def range_form(system: Column, value: Column, range_end: Column) -> Column:
    """Struct of start, end (normal forms; one value is both) and their keys. Made once per row, by a lambda, so that a plan that
    uses it often holds its expressions once."""
    one = F.struct(system.alias("system"), value.alias("value"), range_end.alias("range_end"))
    ends = F.transform(F.array(one), lambda x: F.struct(x["system"].alias("system"), normalize(x["system"], x["value"]).alias("start"), normalize(x["system"], x["range_end"]).alias("other")))
    ends = F.transform(ends, lambda x: F.struct(x["system"].alias("system"), x["start"].alias("start"), F.coalesce(x["other"], x["start"]).alias("end")))
    return F.transform(ends, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), key(x["system"], x["start"]).alias("start_key"), key(x["system"], x["end"]).alias("end_key")))[0]


def cited_forms(raw: Column) -> Column:
    """Array of structs, one per kind of SYSTEMS: raw, start, end and their keys, as the kind reads the cited location."""
    read = F.transform(F.array(*map(F.lit, SYSTEMS)), lambda s: F.struct(s.alias("system"), normalize(s, raw).alias("raw")))
    cut = F.transform(read, lambda x: F.struct(x["system"].alias("system"), x["raw"].alias("raw"), bounds(x["raw"]).alias("b")))
    return F.transform(cut, lambda x: F.struct(x["system"].alias("system"), x["raw"].alias("raw"), x["b"][0].alias("start"), x["b"][1].alias("end"), key(x["system"], x["b"][0]).alias("start_key"), key(x["system"], x["b"][1]).alias("end_key")))


def of_system(forms: Column, system: Column) -> Column:
    """The form that the kind reads."""
    return F.coalesce(F.get(F.filter(forms, lambda f: f["system"] == system), F.lit(0)), F.element_at(forms, -1))


def within(start: Column, end: Column, value: Column, a: Column, b: Column, v: Column) -> Column:
    """Whether value, with key v, lies between start and end, with keys a and b; where a key is missing, whether it equals one of them."""
    return F.when(a.isNull() | b.isNull() | v.isNull(), (value == start) | (value == end)).otherwise((a <= v) & (v <= b))


def meet(start: Column, end: Column, other_start: Column, other_end: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two ranges, with keys a, b and c, d, overlap; where a key is missing, whether they share a bound."""
    equal = start.isin(other_start, other_end) | end.isin(other_start, other_end)
    return F.when(a.isNull() | b.isNull() | c.isNull() | d.isNull(), equal).otherwise((a <= d) & (c <= b))


def contains(system: Column, start: Column, end: Column, value: Column) -> Column:
    return within(start, end, value, key(system, start), key(system, end), key(system, value))


def overlap(system: Column, start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return meet(start, end, other_start, other_end, *(key(system, x) for x in (start, end, other_start, other_end)))


def display(value: Column, range_end: Column) -> Column:
    """The value, with an en dash and the end of a range."""
    return F.concat_ws("\u2013", value, range_end)


def display_with_prefix(system: Column, value: Column, range_end: Column) -> Column:
    shown = display(value, range_end)
    return F.when(system == "section", F.concat(F.lit("\u00a7"), shown)).when(system == "page", F.concat(F.when(range_end.isNotNull(), "pp. ").otherwise("p. "), shown)).when(system == "chapter", F.concat(F.lit("ch. "), shown)).otherwise(shown)
