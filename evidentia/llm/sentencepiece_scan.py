"""Encoding with a fixed public vocabulary of pieces, and decoding.

A text gets the pieces with the largest sum of scores (Viterbi). A piece's score is -log(1 + rank), in fixed point so that sums
are exact; a sign without a piece becomes the byte pieces of its UTF-8 form. Among equal sums the longer last piece wins, from
the end backwards. The text is encoded with a space before it, as the vocabulary has it.

No piece has a space after another sign, so a cut lies before each space that follows another sign. What is between such cuts,
a unit, is encoded alone, and each distinct unit once.

A text of more than `chunk` signs is cut into chunks anywhere. A chunk's state is how far beyond its start the first cut lies
(0 to the longest piece less 1). Its transfer matrix holds the best score from each state at its start to each at its end.
Matrices are multiplied (max, plus) in a tree, block by block; so each chunk gets the best scores of its start states. With
these it knows for each end state the start state of the best path: a map, and maps are composed in the same kind of tree.
Then each chunk is traced back alone from its end state. Spark shuffles matrices, maps and states, not texts.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import map_batches, materialize, slices
from evidentia.llm.vocab import SPACE, TOKENIZER_DIR, PieceTable, model_bytes

CHUNK = 1 << 15
#: Bytes of text, about, whose units are encoded together.
SLICE = 1_000_000
#: Chunks, or blocks of chunks, that one task multiplies at a time.
BLOCK = 64
IMPOSSIBLE = -(1 << 60)
_UNITS, _CUT = re.compile(r" *[^ ]+| +"), re.compile("(?<! ) ")
#: Distinct units that a task keeps.
KEPT_UNITS = 200_000
#: Signs of a unit up to which it is encoded along with others of its length.
LONG_UNIT = 64
#: Signs of the units of one length that are encoded at a time.
_CELLS = 500_000


def _names(text: str) -> list[str]:
    """The units of a space and the text, each without its first space."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in _UNITS.findall(" " + text)]
    return text.split(" ")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    def __init__(self, pieces: list[str], ranks: list[int], byte_ids: dict[int, int], special: set[int]):
        normal = [i for i in range(len(pieces)) if i not in special and i not in byte_ids]
        texts = {i: pieces[i].replace(SPACE, " ") for i in normal}
        if any(" " in t.lstrip(" ") for t in texts.values()):
            raise ValueError("the vocabulary has pieces with a space after another sign")
        self.score = {t: round(-math.log(1 + ranks[i]) * 65536) for i, t in texts.items()}
        self.id = {t: i for i, t in texts.items()}
        self.unknown = min(self.score.values()) - 10 * 65536
        self.longest = max(map(len, self.id))
        self.begins = {t[:k] for t in self.id for k in range(1, len(t) + 1)}
        self.bytes = [b""] * len(pieces)
        self.clear()
        for i, t in texts.items():
            self.bytes[i] = t.encode()
        for i, b in byte_ids.items():
            self.bytes[i] = bytes([b])
        self.byte_id = {b: i for i, b in byte_ids.items()}
        raw = list(map(len, self.bytes))
        self.raw_size, self.raw_bytes = np.array(raw, np.int64), np.frombuffer(b"".join(self.bytes), np.uint8)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        scores = [self.score[texts[i]] if i in texts else IMPOSSIBLE for i in range(len(pieces))]
        self.score_of, self.table = np.array(scores, np.int64), PieceTable(pieces, scores, sorted(byte_ids))

    def viterbi(self, t: str, entries: dict[int, int], starts_below: int, end: int) -> tuple[dict[int, int], dict[int, int]]:
        """Best score of each reachable position up to end, and where the piece that ends there starts (-1: an entry).

        Pieces start at or after the first entry and before starts_below.
        """
        best, back = dict(entries), dict.fromkeys(entries, -1)
        score, begins, longest = self.score.get, self.begins, self.longest
        for q in range(min(entries), min(starts_below, end)):
            v = best.get(q)
            if v is None:
                continue
            for p in range(q + 1, min(q + longest, end) + 1):
                piece = t[q:p]
                s = score(piece)
                if s is None and p == q + 1:
                    s = self.unknown
                if s is not None:
                    known = best.get(p)
                    if known is None or v + s > known:
                        best[p] = v + s
                        back[p] = q
                if piece not in begins:
                    break
        return best, back

    def ids_of(self, t: str, q: int, p: int) -> list[int]:
        i = self.id.get(t[q:p])
        return [i] if i is not None else [self.byte_id[b] for b in t[q:p].encode()]

    def trace(self, t: str, back: dict[int, int], p: int) -> tuple[list[int], int]:
        """Ids of the pieces before p, and the entry that they start from."""
        spans = []
        while (q := back[p]) >= 0:
            spans.append((q, p))
            p = q
        return [i for q, e in reversed(spans) for i in self.ids_of(t, q, e)], p

    def clear(self) -> None:
        """Forget all units: the number of each, then by number its score, its ids' place and count, whether they give it back."""
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.total, self.start, self.size, self.ok, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)

    def _encode_group(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, counts of ids, and ids one after another, of units of one length, all at a time."""
        n, size = len(units[0]), len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(size, n)
        # the vocabulary writes a space as a mark; the mark itself in a text is no piece
        codes = np.where(codes == ord(SPACE), np.uint32(0xFFFFFFF0), np.where(codes == 32, np.uint32(ord(SPACE)), codes)).T.copy()
        best = np.full((n + 1, size), IMPOSSIBLE, np.int64)
        best[0] = 0
        back, piece, steps = np.zeros((n + 1, size), np.int16), np.full((n + 1, size), -1, np.int32), np.zeros((n + 1, size), np.int32)
        for q in range(n):
            at = np.flatnonzero(best[q] + self.unknown > best[q + 1])
            best[q + 1, at], back[q + 1, at], piece[q + 1, at] = best[q, at] + self.unknown, q, -1
            for k, at, ids in self.table.pieces_at(codes, q):
                p = q + k
                value = best[q][at] + self.score_of[ids]
                better = np.flatnonzero(value > best[p][at])
                at = at[better]
                best[p][at], back[p][at], piece[p][at], steps[p][at] = value[better], q, ids[better], steps[q][at] + 1
            # a sign without a piece takes a step for each of its bytes
            lone = np.flatnonzero((piece[q + 1] < 0) & (back[q + 1] == q))
            steps[q + 1, lone] = steps[q, lone] + self._utf8(codes[q, lone])
        sizes = steps[n].astype(np.int64)
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]), np.int32)
        live, at, first = np.arange(size), np.full(size, n), ends - sizes
        while len(live):
            got, begin = piece[at, live], back[at, live].astype(np.int64)
            known = got >= 0
            out[first[live[known]] + steps[at[known], live[known]] - 1] = got[known]
            for i, b in zip(live[~known].tolist(), begin[~known].tolist(), strict=True):
                x = [self.byte_id[c] for c in units[i][b].encode("utf-8", "surrogatepass")]
                j = int(first[i]) + int(steps[b, i])
                out[j : j + len(x)] = x
            more = begin > 0
            live, at = live[more], begin[more]
        return best[n], sizes, out

    @staticmethod
    def _utf8(codes: np.ndarray) -> np.ndarray:
        """Bytes of each sign; the set-aside space mark has three."""
        return np.where(codes == 0xFFFFFFF0, 3, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))

    def _learn(self, new: list[str]) -> None:
        """Encode units that have got a number but no ids yet."""
        chars = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(chars, kind="stable")
        sizes, total, parts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), []
        for group in np.split(order, np.flatnonzero(np.diff(chars[order])) + 1):
            n = int(chars[group[0]])
            step = max(1, _CELLS // (n + 1)) if n < LONG_UNIT else 1
            for j in range(0, len(group), step):
                here = group[j : j + step]
                units = [" " + new[i] for i in here.tolist()]
                if n < LONG_UNIT:
                    total[here], sizes[here], ids = self._encode_group(units)
                else:
                    best, back = self.viterbi(units[0], {0: 0}, n + 1, n + 1)
                    ids = np.array(self.trace(units[0], back, n + 1)[0], np.int32)
                    total[here], sizes[here] = best[n + 1], len(ids)
                parts.append(ids)
        flat, mine = np.concatenate(parts), order
        start = np.zeros(len(new), np.int64)
        start[mine] = np.cumsum(sizes[mine]) - sizes[mine]
        # whether the pieces' bytes, one after another, are the unit's
        units = [" " + new[i] for i in mine.tolist()]
        text = "".join(units)
        raw = text.encode("utf-8", "surrogatepass")
        length = chars[mine] + 1 if text.isascii() else np.fromiter((len(u.encode("utf-8", "surrogatepass")) for u in units), np.int64, len(units))
        of_ids = self.raw_size[flat]
        given = np.add.reduceat(of_ids, np.cumsum(sizes[mine]) - sizes[mine]) if len(flat) else length * 0
        ok = np.ones(len(new), bool)
        same = given == length
        if same.all():
            differs = self.raw_bytes[_ranges(self.raw_start[flat], of_ids)] != np.frombuffer(raw, np.uint8)
            same = np.add.reduceat(differs, np.cumsum(length) - length) == 0
        else:
            ends = np.cumsum(sizes[mine])
            same = np.array([self.raw(flat[e - k : e].tolist()) == u.encode("utf-8", "surrogatepass") for e, k, u in zip(ends.tolist(), sizes[mine].tolist(), units, strict=True)])
        ok[mine] = same
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])
        self.size, self.total, self.ok = np.concatenate([self.size, sizes]), np.concatenate([self.total, total]), np.concatenate([self.ok, ok])

    def encode_all(self, texts: list[str | None], keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another; of each text the number of ids, the score, and whether the ids give it back.

        keep: what is known of units stays, however much it is.
        """
        if len(self.number) > KEPT_UNITS and not keep:
            self.clear()
        split = [_names(t) if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if len(self.number) > len(self.size):
            self._learn(list(islice(self.number, len(self.size), None)))
        size = self.size[at]
        ends = np.cumsum(n)
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        of_text = lambda x: upto(x)[ends] - upto(x)[ends - n]
        return self.flat[_ranges(self.start[at], size)], of_text(size), of_text(self.total[at]), of_text(~self.ok[at]) == 0

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text], keep=True)[0].tolist()

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.raw(ids).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = {i: int(pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
    return Encoder(pieces, [int(min(-sp.get_score(i), n)) for i in range(n)], byte_ids, special)


class Chunk:
    """One chunk: body has core signs and, unless it is the last, some of what follows; before is the sign before it."""

    def __init__(self, e: Encoder, body: str, core: int, before: str, last: bool):
        self.e, self.t, self.core, self.states = e, body, core, e.longest
        self.end = core if last else min(len(body), core + e.longest - 1)
        #: The first cut and the last one, or nothing.
        first, last = _CUT.search(before + body[:core], len(before)), body.rfind(" ", 0, core)
        while last > 0 and body[last - 1] == " ":
            last -= 1
        self.cuts = (first.start() - len(before), last) if first else ()

    def head_end(self) -> int:
        return self.cuts[0] if self.cuts else self.core

    def _tail(self, entries: dict[int, int]):
        return self.e.viterbi(self.t, entries, self.core, self.end)

    def middle(self) -> str:
        """What lies between the first cut and the last one, without its first space."""
        return self.t[self.cuts[0] + 1 : self.cuts[-1]]

    def matrix(self) -> np.ndarray:
        n = self.states
        m = np.full((n, n), IMPOSSIBLE, np.int64)
        ways = [i for i in range(n) if i <= (self.head_end() if self.cuts else self.end)]
        if not self.cuts:
            return self._whole_matrix(m)
        u = self.head_end()
        to_cut = np.array([self.e.viterbi(self.t, {i: 0}, u, u)[0].get(u, IMPOSSIBLE) if i in ways else IMPOSSIBLE for i in range(n)], np.int64)
        best, _ = self._tail({self.cuts[-1]: 0})
        from_cut = np.array([best.get(self.core + j, IMPOSSIBLE) for j in range(n)], np.int64)
        middle = int(self.e.encode_all([self.middle()], keep=True)[2][0])
        return np.maximum(to_cut[:, None] + from_cut[None, :] + middle, IMPOSSIBLE)

    def _whole_matrix(self, m: np.ndarray) -> np.ndarray:
        """The matrix of a chunk without a cut: the best scores from all start states go along together, position by position."""
        n, e, best = self.states, self.e, {}
        for q in range(self.core):
            here = best.pop(q, None)
            if q < n:
                here = np.full(n, IMPOSSIBLE, np.int64) if here is None else here
                here[q] = max(here[q], 0)
            if here is None:
                continue
            for p in range(q + 1, min(q + e.longest, self.end) + 1):
                piece = self.t[q:p]
                s = e.score.get(piece, e.unknown if p == q + 1 else None)
                if s is not None:
                    known = best.get(p)
                    best[p] = here + s if known is None else np.maximum(known, here + s)
                if piece not in e.begins:
                    break
        for j in range(n):
            if self.core + j <= self.end and self.core + j in best:
                m[:, j] = best[self.core + j]
            if self.core + j < n and self.core + j <= self.end:
                m[self.core + j, j] = max(m[self.core + j, j], 0)
        return np.where(m < IMPOSSIBLE // 2, IMPOSSIBLE, m)

    def _head(self, scores: np.ndarray):
        limit = self.head_end() if self.cuts else self.end
        entries = {i: int(s) for i, s in enumerate(scores) if s > IMPOSSIBLE and i <= limit}
        return self.e.viterbi(self.t, entries, limit, limit) if self.cuts else self._tail(entries)

    def start_states(self, scores: np.ndarray) -> list[int]:
        """For each end state the start state of the best path; -1 where there is none."""
        _, back = self._head(scores)
        if self.cuts:
            start = self.e.trace(self.t, back, self.cuts[0])[1]
            best, _ = self._tail({self.cuts[-1]: 0})
            return [start if self.core + j in best else -1 for j in range(self.states)]
        return [self.e.trace(self.t, back, self.core + j)[1] if self.core + j in back else -1 for j in range(self.states)]

    def ids(self, scores: np.ndarray, end_state: int) -> tuple[list[int], int]:
        """The pieces of the path to the end state, and where the first one starts."""
        _, back = self._head(scores)
        at = self.core + end_state
        if not self.cuts:
            return self.e.trace(self.t, back, at)
        head, start = self.e.trace(self.t, back, self.cuts[0])
        _, tail = self._tail({self.cuts[-1]: 0})
        return head + self.e.encode(self.middle()) + self.e.trace(self.t, tail, at)[0], start


@dataclass(frozen=True)
class Monoid:
    """Values of chunks, how two neighbours combine, and how a state passes a value; backwards: from the end of the text."""

    shape: tuple[int, ...]
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    passed: Callable[[np.ndarray, np.ndarray], np.ndarray]
    first: np.ndarray
    backwards: bool = False


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), IMPOSSIBLE)


def max_plus(n: int) -> Monoid:
    first = np.full(n, IMPOSSIBLE, np.int64)
    first[0] = 0
    return Monoid((n, n), _times, lambda s, m: np.maximum((s[:, None] + m).max(axis=0), IMPOSSIBLE), first)


def composed(n: int) -> Monoid:
    """Maps from end to start states; the later chunk's map comes first."""
    through = lambda f, x: np.where(x >= 0, f[np.maximum(x, 0)], -1)
    return Monoid((n,), lambda later, f: through(f, later), lambda s, f: through(f, s), np.zeros(1, np.int64), backwards=True)


def scan(values: DataFrame, m: Monoid, label: str) -> DataFrame:
    """text, c, state: what reaches each chunk, from rows (text, c, v). Two levels: blocks of BLOCK chunks are folded apart, then a text's blocks
    (one for two million signs) are passed through, then each block's chunks."""
    values = materialize(values, label)
    way = -1 if m.backwards else 1

    def ordered(rows: pa.Table, by: str, name: str) -> list[np.ndarray]:
        rows = rows.sort_by([(by, "ascending" if way > 0 else "descending")])
        return [v.values.to_numpy() for v in rows.column(name)]

    def fold(key: str, by: str):
        def run(rows: pa.Table) -> pa.Table:
            out = None
            for v in ordered(rows, by, "v"):
                x = v.reshape(m.shape)
                out = x if out is None else m.combine(out, x)
            return pa.table({"text": rows.column("text")[:1], key: rows.column(key)[:1], "v": pa.array([out.ravel()], pa.list_(pa.int64()))})

        return run

    def reach(by: str):
        def run(rows: pa.Table) -> pa.Table:
            state, states = ordered(rows, by, "start")[0] if "start" in rows.column_names else m.first, []
            for v in ordered(rows, by, "v"):
                states.append(state)
                state = m.passed(state, v.reshape(m.shape))
            rows = rows.sort_by([(by, "ascending" if way > 0 else "descending")])
            return pa.table({"text": rows.column("text"), by: rows.column(by), "state": pa.array(states, pa.list_(pa.int64()))})

        return run

    blocked = values.withColumn("block", F.expr(f"c div {BLOCK}"))
    blocks = blocked.groupBy("text", "block").applyInArrow(fold("block", "c"), "text long, block long, v array<long>")
    starts = blocks.groupBy("text").applyInArrow(reach("block"), "text long, block long, state array<long>")
    inside = blocked.join(starts.withColumnRenamed("state", "start"), ["text", "block"])
    return inside.groupBy("text", "block").applyInArrow(reach("c"), "text long, c long, state array<long>")


def _chunks(giant: DataFrame, size: int, longest: int) -> DataFrame:
    """text (a number of the row), doc_id, c, body, core, before, last."""
    n = F.ceil(F.char_length("t") / F.lit(size)).cast("long")
    cut = giant.select("doc_id", F.monotonically_increasing_id().alias("text"), F.concat(F.lit(" "), "text").alias("t")).select("text", "doc_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("c"))
    at = F.col("c") * size
    left = F.char_length("t") - at
    return cut.select(
        "text", "doc_id", "c", F.substring("t", (at + 1).cast("int"), F.lit(size + longest - 1)).alias("body"), F.least(left, F.lit(size)).cast("int").alias("core"),
        F.when(F.col("c") > 0, F.substring("t", at.cast("int"), F.lit(1))).otherwise(F.lit("")).alias("before"), (left <= size).alias("last"),
    )


def _per_chunk(chunks: DataFrame, model: bytes, schema: str, work: Callable[[Chunk, dict], dict], units: bool) -> DataFrame:
    """work of each chunk; where it needs all units, those of a slice of chunks are encoded together first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in slices(batches, "body", SLICE):
            rows = b.to_pylist()
            here = [Chunk(e, r["body"], r["core"], r["before"], r["last"]) for r in rows]
            if units:
                e.encode_all([x.middle() for x in here if x.cuts])
            if rows:
                yield pa.RecordBatch.from_pylist([{"text": r["text"], "c": r["c"]} | work(x, r) for x, r in zip(here, rows, strict=True)])
        e.clear()

    return map_batches(chunks, run, f"text long, c long, {schema}")


def encode(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_tokens (long), ids, restored (whether decoding gives the text back).

    Needs doc_id and text; other columns are ignored. A null text has null ids and 0 tokens, an empty one no ids; both count as
    restored. Repeated rows, and rows with one doc_id or none, are encoded each by itself. An empty table gives an empty result.
    """
    model = model_bytes(tokenizer_dir)
    longest = encoder(model).longest
    texts = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in slices(batches, most=SLICE):
            flat, n, _, ok = e.encode_all(b.column("text").to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat), mask=b.column("text").is_null())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n), "ids": ids, "restored": pa.array(ok)})
        e.clear()

    out = "doc_id long, n_tokens long, ids array<int>, restored boolean"
    is_giant = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    direct = map_batches(texts.where(~is_giant), run, out)

    chunks = materialize(_chunks(texts.where(is_giant), chunk, longest), "chunks")
    pieces = chunks.drop("doc_id")
    matrices = _per_chunk(pieces, model, "v array<long>", lambda x, _: {"v": x.matrix().ravel()}, units=True)
    scores = materialize(scan(matrices, max_plus(longest), "matrices").withColumnRenamed("state", "scores"), "scores")
    scored = pieces.join(scores, ["text", "c"])
    maps = _per_chunk(scored, model, "v array<long>", lambda x, r: {"v": x.start_states(np.array(r["scores"]))}, units=False)
    ends = materialize(scan(maps, composed(longest), "maps").withColumnRenamed("state", "end_state"), "ends")

    def trace(x: Chunk, r: dict) -> dict:
        end = r["end_state"][0]
        ids, start = x.ids(np.array(r["scores"]), end)
        return {"ids": np.array(ids, np.int32), "ok": x.e.raw(ids).decode("utf-8", "replace") == x.t[start : x.core + end]}

    traced = _per_chunk(scored.join(ends, ["text", "c"]), model, "ids array<int>, ok boolean", trace, units=True)
    whole = traced.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts"), F.bool_and("ok").alias("restored"))
    whole = whole.select("text", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), "restored").join(chunks.where("c = 0").select("text", "doc_id"), "text")
    return direct.unionByName(whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored"))


def decode(encoded: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text. Null ids give a null text."""
    model = model_bytes(tokenizer_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            texts = [None if x is None else e.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
