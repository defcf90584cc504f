"""Byte-pair token counts: rank-ordered merges over the bytes of pre-tokenised pieces, once per distinct piece of a task."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import batches

#: A public vocabulary: a line per token, its bytes in base 64 and its rank.
PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are cut into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a task remembers, and the length up to which it does.
_KEPT, _SHORT = 200_000, 64


@lru_cache(maxsize=4)
def read_ranks(path: str = PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The piece's tokens: single bytes, of which the neighbours whose union has the least rank are merged, the first of equal ones, until none has."""
    if piece in ranks:
        return [piece]
    n = len(piece)
    # each part starts at its place; after it comes the next, and -1 marks a part that is gone
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, to = heapq.heappop(waiting)
        j = end[i]
        if j < 0 or j >= n or end[j] != to:
            continue  # one of the two has changed since
        end[i], end[j] = to, -1
        if to < n:
            before[to] = i
            if (rank := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(waiting, (rank, i, end[to]))
        if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:to])) is not None:
            heapq.heappush(waiting, (rank, h, to))
    return [piece[i : end[i]] for i in range(n) if end[i] > 0]


class _Counts(dict):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = len(merges(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= _SHORT:
            if len(self) >= _KEPT:
                self.clear()
            self[piece] = n
        return n


_PIECES = regex.compile(PIECES)


def count(text: str | None, counts: _Counts) -> int:
    return sum(counts[m.group()] for m in _PIECES.finditer(text)) if text else 0


def counter(path: str = PATH) -> Callable[[Column], Column]:
    """A function from an array of texts to an array of their numbers of tokens, null to 0; a null array has none.

    The vocabulary is read where the function is made and sent with it, as executors may not see the file.
    """
    ranks = read_ranks(path)
    batches.bound(SparkSession.getActiveSession())

    @F.arrow_udf(returnType="array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        counts = _SENT.setdefault(path, _Counts(ranks))
        return pa.array([None if row is None else [count(t, counts) for t in row] for row in texts.to_pylist()], pa.list_(pa.int32()))

    return lambda texts: counted(texts)


#: Counts of this process by vocabulary.
_SENT: dict[str, _Counts] = {}


def token_count(text: Column, path: str = PATH) -> Column:
    """Tokens of a text; 0 for null."""
    return F.get(counter(path)(F.array(text)), F.lit(0))
