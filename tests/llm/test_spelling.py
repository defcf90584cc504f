"""Spelling variants against a plain search of all pairs."""

import random
import zlib
from collections import Counter

import pytest
import re

from evidentia.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def plain_words(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_variants_match_all_pairs(spark):
    r, rows = random.Random(2), []
    base = ["".join(r.choice("abcdeéß") for _ in range(r.randint(4, 9))) for _ in range(40)]
    for i in range(60):
        words = []
        for _ in range(80):
            w = r.choice(base[: 1 + int(40 * r.random() ** 2)])
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + r.choice("abcdeéÿ") + w[k:], w[: max(0, k - 1)] + w[k:], w[: max(0, k - 1)] + r.choice("abcß") + w[k:]]) or "a"
            words.append(r.choice([w, w, w.title(), w.upper()]))
        rows.append((i, r.choice([" ", ", ", "1", "\n"]).join(words), "clash", "clash"))
    rows += [(None, "abcde abcde abcdf ABCDE abcde", "x", "y"), (61, None, "x", "y"), (62, "", "x", "y"), rows[0], rows[0], (63, ("q" * 3000 + " ") * 9 + ("q" * 2999 + " ") * 3 + "\u00d7\u00f7" * 4, "x", "y")]
    found = rows_of(spelling.variants(spark.createDataFrame(rows, SCHEMA)))
    expected = plain_variants(rows)
    assert found == expected and len(found) > 150 and sum(f is not None for _, f, *_ in found) > 50
    assert any(f and root != f for _, f, root, *_ in found)  # ways of several steps


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "too few words here")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("k", [2, 3, 6])
def test_neighbourhoods_are_whole_and_each_once(k):
    r = random.Random(k)
    words = ["".join(str(r.randrange(k)) for _ in range(n)) for n in (1, 2, 3, 5, 5, 8, 8, 13)]
    alphabet = [str(c) for c in range(k)]
    expected = set()
    for w in set(words):
        around = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        own = int(spelling.hashes([w])[0])
        expected |= {(own, int(h)) for h in spelling.hashes(sorted(around))}
    for most in (spelling._MOST, 7):  # in parts of any size
        before, spelling._MOST = spelling._MOST, most
        found = [(int(a), int(b)) for own, other in spelling.neighbourhoods(sorted(set(words)), k) for a, b in zip(own, other)]
        spelling._MOST = before
        assert len(found) == len(set(found)) and set(found) == expected


def test_nothing_that_grows_with_the_vocabulary_is_broadcast(spark, monkeypatch):
    """F1 of round 4: Spark takes the neighbourhoods for a small table, at any size below its threshold, and collects them on the driver."""
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    written = spelling.materialize
    monkeypatch.setattr(spelling, "materialize", noted)
    out = spelling.variants(spark.createDataFrame([(i, "abcde abcdf abcdee wordy", "", "") for i in range(9)], SCHEMA))
    assert out.count() == 4
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
