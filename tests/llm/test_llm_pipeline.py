"""The pipeline's stages in a row, against plain Python versions of each in the same order."""

import random

import numpy as np
import pytest
from plain import plain_components, plain_copies, plain_ids, plain_spans
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import language_id, substring_dedup
from evidentia.llm.common import is_held_out
from evidentia.llm.vocab import piece_table

WORDS = {
    "en": "the and of reading water stone light under over house river long small people time year work place hand eye".split(),
    "de": "der die und nicht straße über schön häuser fließen wasser stein licht unter haus fluss lang klein leute zeit jahr".split(),
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(31)
    prose = lambda lang, n: " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    passage = " ".join(f"{r.choice(WORDS['en'])}{k % 7}x{'abcdefghij'[k % 10]}" for k in range(60))
    rows = [(i, prose(lang, r.randint(30, 120)), lang, f"s{i % 3}") for i, lang in enumerate(["en", "en", "de"] * 9)]
    base = rows[4][1]
    rows += [(40, base, "en", "s0"), (41, base.replace("stone", "brick", 1), "en", "s1"), (42, f"{prose('en', 40)} {passage} {prose('en', 40)}", "en", "s2"), (43, f"{prose('en', 30)} {passage} {prose('en', 20)}", "en", "s1")]
    rows += [(50, None, None, "s0"), (51, "", "en", None), (52, "½ ② 123 !!", None, "s1"), (53, "Это русский текст о погоде и о море " * 5, None, "s1"), (54, prose("de", 40), None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("h", F.lit("clash"))
    folder = f"{tmp_path_factory.mktemp('sf')}"
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, docs, rows


def identified(docs, rows):
    """Rows whose likeliest language has at least an even chance, by a forward sum word by word."""
    model = language_id.fit(docs.where(~is_held_out()))
    table = piece_table(model.vocabulary)

    def log_p(word, j):
        t = "▁" + word
        best = [1.0] + [0.0] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - table.longest), e):
                i = table.by_text.get(t[s:e], -2 if e - s == 1 else None)
                if i is not None:
                    best[e] += best[s] * model.probs[i, j]
        return np.log(best[-1])

    for row in rows:
        words = language_id.WORD.findall((row[1] or "").lower())
        if words:
            totals = [sum(log_p(w, j) for w in words) for j in range(len(model.languages))]
            j = int(np.argmax(totals))
            strange = language_id.UNLIKE * model.per_letter[j] * sum(map(len, words)) - language_id.DEVIATIONS * model.spread[j] * len(words) ** 0.5
            if 1 / (sum(np.exp(t - totals[j]) for t in totals) + np.exp(min(700, strange - totals[j]))) >= corpus_pipeline.LEAST_SCORE:
                yield row


def test_run_is_its_stages_in_a_row(spark, table):
    folder, docs, rows = table
    left = list(identified(docs, rows))
    assert {r[0] for r in rows} - {r[0] for r in left} == {50, 51, 52, 53}
    components, _ = plain_components({r[0]: r[1] for r in left}, 5, 80)
    left = sorted(r for r in left if components[r[0]] == r[0])
    assert {40, 41}.isdisjoint(r[0] for r in left)
    spans = plain_spans([r[:2] for r in left], substring_dedup.SpanParams())
    assert spans[43][2] > 0 and spans[42][2] == 0
    left = [(i, spans[i][0], lang, source) for i, _, lang, source in left]
    named = docs.withColumn("d", F.expr(corpus_pipeline.queries.DOMAIN))
    domain = {r.doc_id: r.d for r in named.collect()}
    copies = plain_copies({r[0]: len(r[1].split()) for r in left}, {r[0]: (domain[r[0]], r[2] or "", r[3] or "") for r in left}, corpus_pipeline.MIX)
    expected = {r[0]: plain_ids(r[1]) for r in left if copies[r[0]]}
    found = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == expected and 0 < len(found) < len(left)


def test_stages_take_odd_tables(spark, table):
    """Columns besides, of clashing names, are kept by all stages but the last; an empty table stays empty."""
    folder, docs, _ = table
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, folder).count() == 0, name
        assert sorted(stage(spark, docs, folder).columns) == sorted(docs.columns), name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0
