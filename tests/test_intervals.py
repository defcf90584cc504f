"""The interval join against a comparison of all with all."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import intervals

LETTERS = "abcde"


def ordered(system, value):
    """The location as a tuple that sorts as it does; None for what has no ordered form."""
    v = value.removeprefix("p. ")
    if system == "page":
        return (int(v),) if v.isdigit() else None
    if system == "stephanus":
        return (int(v[:-1]), LETTERS.index(v[-1])) if v[:-1].isdigit() and v[-1] in LETTERS else None
    if system == "section":
        # numbers come before letters, which count in base 26
        parts = [(0, int(p)) if p.isdigit() else (1, sum((ord(c) - 96) * 26**k for k, c in enumerate(reversed(p)))) for p in v.split(".")]
        return tuple(x for p in parts for x in p)
    return None


def plain(cited, held):
    out = []
    for i, work, system, value, end in cited:
        for j, other, kind, v, e in held:
            if None in (work, system, value, v) or (work, system) != (other, kind):
                continue
            bounds, others = [x.removeprefix("p. ") for x in (value, end or value)], [x.removeprefix("p. ") for x in (v, e or v)]
            (a, b), (c, d) = ([ordered(system, x) for x in s] for s in (bounds, others))
            if None in (a, b, c, d):
                meets = bool(set(bounds) & set(others))
            else:
                meets = a <= d and c <= b
            inside = bounds[0] in others if None in (a, c, d) else c <= a <= d
            if meets:
                out.append((i, j, inside))
    return sorted(out)


def made(r, n, first, works):
    rows = []
    for i in range(n):
        system = r.choice(["page", "stephanus", "section", "other", None])
        at, long = r.randrange(1, 60), r.choice([0, 1, 3, 40])
        value, end = {
            "page": lambda: (f"p. {at}", str(at + long)), "stephanus": lambda: (f"{at}{r.choice(LETTERS)}", f"{at + long}{r.choice(LETTERS)}"),
            "section": lambda: (f"{at % 5}.{at}", f"{at % 5}.{at + long}"), "other": lambda: (f"fr. {at}", f"fr. {at + long}"), None: lambda: ("1", None),
        }[system]()
        if r.random() < 0.15:
            value, end = (end or value), value
        rows.append((first + i, r.choice(works), system, r.choice([value] * 9 + ["xi", None]), r.choice([end, None, ""])))
    return rows


@pytest.mark.parametrize("part", [3, 50_000])
def test_overlaps_match_all_pairs(spark, part):
    """With hot cells that are dealt over parts, ranges from back to front, locations of no form, nulls and repeated rows."""
    r = random.Random(4)
    works = [0, 0, 0, 1, None]
    cited, held = made(r, 150, 0, works), made(r, 120, 1000, works)
    cited += [(900 + i, 0, "page", "p. 7", None) for i in range(40)] + cited[:2]
    left = spark.createDataFrame(cited, "i long, work long, system string, value string, range_end string")
    right = spark.createDataFrame(held, "j long, work long, system string, value string, range_end string")
    found = intervals.overlapping(left, right, ["work"], part)
    assert sorted((r.i, r.j, r.contained) for r in found.collect()) == plain(cited, held)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert intervals.overlapping(left.limit(0), right, ["work"]).count() == 0 == intervals.overlapping(left, right.limit(0), ["work"]).count()


def test_cells_fill_a_range_once(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(-1, 45, 4)]
    for a, b, found in spark.createDataFrame(rows, "a long, b long").select("a", "b", intervals.cells(F.col("a"), F.col("b")).alias("found")).collect():
        covered = [x for c in found for x in range(c.cell << c["size"], (c.cell + 1) << c["size"])]
        assert sorted(covered) == list(range(a, b + 1)) and len(found) <= 12


def test_totals_pair_each_location_once(spark, monkeypatch):
    """counts as all pairs give them, from pairs of distinct locations, however often these are repeated."""
    r = random.Random(5)
    cited, held = made(r, 60, 0, ["a", "b", None]), made(r, 60, 0, ["a", "b", None])
    cited, held = [[(i + k * 1000, *x) for k in range(4) for i, *x in rows] for rows in (cited, held)]
    seen, real = [], intervals.overlapping

    def watched(a, b, *rest):
        seen.extend((a.count(), b.count()))
        return real(a, b, *rest)

    monkeypatch.setattr(intervals, "overlapping", watched)
    schema = "work string, system string, value string, range_end string"
    found = intervals.totals(spark.createDataFrame(cited, f"i long, {schema}"), spark.createDataFrame(held, f"j long, {schema}"), ["work"], "j")
    expected = {}
    for i, j, inside in plain(cited, held):
        n, m, least = expected.get(i, (0, 0, j))
        expected[i] = (n + 1, m + inside, min(least, j))
    assert {x.i: (x.n_ranges, x.n_containing, x.first_range) for x in found.collect()} == expected
    assert found.count() == len(expected) and max(seen) <= 60
