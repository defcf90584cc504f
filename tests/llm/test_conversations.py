"""The trie of conversations against a walk over all prefixes."""

import random

from plain import plain_trie

from evidentia.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_trie_matches_a_walk(spark):
    """Nulls in any column, ties, repeated rows, conversations without turns of their own, one longer than many blocks, negative ids."""
    r, rows = random.Random(5), []
    for c in range(200):
        for t in range(r.choice([0, 1, 2, 3, 5, 8, 9, 17, 40])):
            rows.append((c, r.choice([t, None]) if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(["a b", "a", "b c d", None, ""])))
    rows += [(c, t, "u", "x") for c in (300, 301) for t in range(100)] + [(None, 1, "u", "x")] + rows[:20]
    rows += [(c, t, "u", f"y{t % 3}") for c in (-7, -20) for t in range(5)] + [(400, 0, "u", "word " * 5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie.trie(df)) == plain_trie(rows)
    clash = df.selectExpr("*", "1 as depth", "2 as x", "3 as pos", "4 as block")
    assert rows_of(prefix_trie.trie(clash)) == plain_trie(rows)


def test_trie_of_one_group_of_copies(spark):
    """Two thirds of all conversations are alike; their ids go over several texts."""
    rows = [(c, t, "u", f"same {t}" if c % 3 else f"{c} {t}") for c in range(3, 9000) for t in range(2)]
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rows_of(prefix_trie.trie(spark.createDataFrame([(1, None, None, None)], SCHEMA))) == plain_trie([(1, None, None, None)])
