"""Byte-pair counts against merges by a plain loop and against the public encoder of the same vocabulary."""

import os
import random

import pytest
import tiktoken

from evidentia.functions import bpe
from evidentia.operators import chunking

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.PATH), reason="no vocabulary")
TEXTS = [None, "", " ", "It's a wide,  wide world!\n\n", "naïve façade — 漢字かな交じり文 😀 ½²", "a" * 5000, "ab" * 3000 + "\n" * 70, "x1234567890", "they'll've\r\n\tgone  ", "힤", "Ünïcödé ﬁne"]


def plain(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_merges_match_a_plain_loop():
    r, ranks = random.Random(1), bpe.read_ranks()
    for _ in range(400):
        piece = "".join(r.choice("aeinrst th éß漢 ") for _ in range(r.randint(1, 60))).encode()
        assert bpe.merges(piece, ranks) == plain(piece, ranks)


def test_counts_match_the_public_encoder(spark, encoder):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = {r.id: r.n for r in df.select("id", bpe.token_count(df.text).alias("n")).collect()}
    assert found == {i: len(encoder.encode_ordinary(t)) if t else 0 for i, t in rows}


def test_packs_are_bounded_in_tokens(spark, encoder):
    """Each part's tokens are counted alone; packs hold as many as fit."""
    r = random.Random(2)
    sentences = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 40))) + "." for _ in range(200)]
    rows = [(1, 0, " ".join(sentences)), (2, 0, "short"), (3, 0, None), (4, 0, "\n\n".join(sentences[:50]))]
    config = chunking.ChunkConfig(most=100, least=10)
    found = chunking.chunk(spark.createDataFrame(rows, "document_id long, section_index int, text string"), config, bpe.counter()).collect()
    count = lambda t: len(encoder.encode_ordinary(t))
    for doc, parts in ((1, sentences), (4, sentences[:50])):
        packs, now, tokens = [], [], 0
        for s in parts:
            if now and tokens + count(s) > 100:
                packs.append(("\n\n".join(now), tokens))
                now, tokens = [], 0
            now, tokens = [*now, s], tokens + count(s)
        if now and tokens >= 10:
            packs.append(("\n\n".join(now), tokens))
        assert [(c.text, c.token_count) for c in sorted(found, key=lambda c: c.chunk_index) if c.document_id == doc] == packs
    assert {c.document_id for c in found} == {1, 4}


def test_a_giant_piece_takes_little_time():
    assert len(bpe.merges(b"ab" * 200_000, bpe.read_ranks())) > 0
