"""Rules against their patterns, messages against enumeration, and the field against texts of another seed."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest

from evidentia.llm import personal_data as pii

# The patterns as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated(text):
    """The rules' spans by the patterns themselves."""
    out = []
    for k, (name, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[name]()
            if ok:
                out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


ODD = ["", "@", "a@b", "a@b.c@d.e", "x@@y.z", ".@a.b", "é@a.bc", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.0255", "+1 (743) 555-3824 and +1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+4111111111111111", "1.2.3.4@5.6.7.8", "\u00bd+12 34567890(", "+1 (826) 555-4081 190.137.223.20", "a" * 300 + "@b.c"]


def test_rules_are_the_stated_patterns():
    r = np.random.default_rng(3)
    for text in ODD + ["".join(r.choice(list("ab1239.@+-() ,%\n"), 60, p=None)) for _ in range(3000)] + pii.written(5, 60)[0]:
        assert pii.base_spans(text) == stated(text), text


def test_messages_are_exact_on_trees_and_near_on_loops():
    r = np.random.default_rng(8)
    field = pii.Field(r.normal(0, 1, (pii.N_FEATURES, pii.LABELS)), r.normal(0, 0.7, (pii.EDGES, pii.LABELS, pii.LABELS)))
    for edges, near in (([(0, 1, 0), (1, 2, 0), (1, 3, 1), (4, 3, 2)], 1e-3), ([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1), (3, 4, 3)], 0.1)):
        n = 5
        features = np.full((n, pii._WIDTH), -1, np.int16)
        features[:, :3] = r.integers(0, pii.N_FEATURES, (n, 3))
        given = np.array([-1, -1, -1, -1, 2])
        none = np.zeros(n, np.int64)
        g = pii.Graph(features, given, none, np.arange(n), none, none, np.array(edges).T)
        local, exact = field.local(features), np.zeros((n, pii.LABELS))
        for labels in itertools.product(range(pii.LABELS), repeat=n):
            if labels[4] == 2:
                w = np.exp(sum(local[i, labels[i]] for i in range(n)) + sum(field.pairs[t, labels[a], labels[b]] for a, b, t in edges))
                for i in range(n):
                    exact[i, labels[i]] += w
        exact /= exact.sum(axis=1, keepdims=True)
        assert np.abs(pii.marginals(g, field) - exact).max() < near


def test_field_on_other_texts():
    """Mentions that no rule finds, in texts of a seed not learned from; few besides."""
    field = pii.learn()
    texts, truths = pii.written(77, 400)
    bases = [pii.base_spans(t) for t in texts]
    found = pii.further_spans(texts, bases, field, 0.6)
    right = wrong = missed = 0
    for truth, base, more in zip(truths, bases, found):
        wanted = set(truth) - set(base)
        right, wrong, missed = right + len(wanted & set(more)), wrong + len(set(more) - wanted), missed + len(wanted - set(more))
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.97


def test_distant_mentions_are_told_by_each_other():
    """A bare number is a phone number only where the document has it in full, however far away."""
    field = pii.learn()
    far = " the of and reading under water" * 3000
    texts = [f"reach us at +1 (743) 555-3824 soon{far} ask for 743-5553824 today", f"reach us soon{far} ask for 5553824 today", f"reach us at +1 (743) 555-3824 soon{far} ask for 5553824 today"]
    bases = [pii.base_spans(t) for t in texts]
    found = pii.further_spans(texts, bases, field, 0.6)
    assert found[1] == [] and [texts[2][s:e] for _, s, e in found[2]] == ["5553824"] and {k for k, _, _ in found[2]} == {3}
    alone = pii.Field(field.weights, np.concatenate([field.pairs[:1], np.zeros_like(field.pairs[1:])]))
    assert pii.further_spans(texts, bases, alone, 0.6)[2] == []


def test_query_rows(spark):
    texts = [*ODD, None, "   ", "mail: jo [at] mona [dot] de", "x" * 100_000, *pii.written(6, 20)[0]]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(found) == len(rows)
    for r, (i, t, _) in zip(sorted(found, key=lambda r: (r.doc_id or 0)), sorted(rows, key=lambda r: r[0] or 0)):
        base = stated(t or "")
        assert (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) == (i, *(sum(k == j for k, _, _ in base) for j in range(4)))
        names = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",") if r.spans else [])
        at = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in r.spans.split(",") if x]
        assert at == sorted(at)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "@" * 300_000, "a@" * 300_000, "+1" * 300_000, "[at]" * 200_000, "1 " * 300_000, "[" * 500_000 + "at"])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pii.further_spans([text], [pii.base_spans(text)], pii.learn(), 0.6)
    assert time.time() - began < 30
