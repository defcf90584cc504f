"""A fixed public vocabulary of pieces, and vectorised lookup of substrings in it."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

TOKENIZER_DIR = "/opt/tokenizers"
PIECE_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xD6E8FEB86659FD93)


def model_bytes(tokenizer_dir: str = TOKENIZER_DIR) -> bytes:
    """The vocabulary file as bytes (half a MB), to be read on the driver and shipped in a task's closure."""
    with open(os.path.join(tokenizer_dir, PIECE_MODEL), "rb") as f:
        return f.read()


class PieceTable:
    """Ordinary pieces by a 64-bit hash of their code points; byte pieces by value."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], bits: int = 20):
        self.pieces, self.scores, self.byte_ids = pieces, np.array(scores), byte_ids
        normal = [i for i, p in enumerate(pieces) if p and i > 2 and i not in set(byte_ids)]
        self.longest = max(len(pieces[i]) for i in normal)
        self.by_text = {pieces[i]: i for i in normal}
        self.shift = np.uint64(64 - bits)
        size = 1 << bits
        self.begins, self.chained = np.zeros(size, bool), np.zeros(size, bool)
        self.keys, self.ids, self.probes = np.zeros(size + 64, np.uint64), np.full(size + 64, -1, np.int32), 1
        for i in normal:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in pieces[i]:
                    h = h * _MUL + np.uint64(ord(c) + 1)
                    slot = int((h * _SLOT) >> self.shift)
                    self.begins[slot] = True
            step = 0
            while self.ids[slot + step] >= 0:
                self.chained[slot] = True
                step += 1
            self.keys[slot + step], self.ids[slot + step] = h, i
            self.probes = max(self.probes, step + 1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        slot = ((h * _SLOT) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        for step in range(1, self.probes):
            at = np.flatnonzero((out < 0) & (self.ids[slot + step - 1] >= 0))
            if not len(at):
                break
            deeper = slot[at] + step
            out[at] = np.where(self.keys[deeper] == h[at], self.ids[deeper], -1)
        return out

    def spans(self, codes: np.ndarray, start: int):
        """For rows of code points of one length: (k, ids) for each span of k points from start."""
        h = np.zeros(len(codes), np.uint64)
        for k in range(1, min(self.longest, codes.shape[1] - start) + 1):
            h = h * _MUL + (codes[:, start + k - 1].astype(np.uint64) + np.uint64(1))
            yield k, self.lookup(h)


    def pieces_at(self, codes: np.ndarray, start: int):
        """For columns of code points of one length: (k, columns, ids) for each span of k points from start that is a piece; only
        columns in which a piece may still begin so are looked at."""
        at, h = np.arange(codes.shape[1]), np.zeros(codes.shape[1], np.uint64)
        for k in range(1, min(self.longest, len(codes) - start) + 1):
            h = h * _MUL + (codes[start + k - 1, at].astype(np.uint64) + np.uint64(1))
            slot = ((h * _SLOT) >> self.shift).view(np.int64)
            live = np.flatnonzero(self.begins[slot])
            if not len(live):
                return
            at, h, slot = at[live], h[live], slot[live]
            same = self.keys[slot] == h
            ids = np.where(same, self.ids[slot], -1)
            again = np.flatnonzero(~same & self.chained[slot])
            if len(again):
                ids[again] = self.lookup(h[again])
            known = np.flatnonzero(ids >= 0)
            yield k, at[known], ids[known]


@lru_cache(maxsize=2)
def piece_table(model: bytes) -> PieceTable:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    return PieceTable([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [i for i in range(n) if sp.is_byte(i)])
