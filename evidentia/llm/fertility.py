"""Quality rules on how a public vocabulary cuts a text.

Three figures of a whole text: characters per token (of its words), the share of tokens that are single bytes for want of a
piece, and the entropy of its tokens relative to what as many tokens could have, less its usual course with the text's length (a
line in the logarithm of the words). A document fails where a figure lies outside the band of its language, of its dominant
script where no language is given or too few documents have it, of all documents where the script is rare too. Bands come from
all documents: each figure has a lower and an upper limit of its own, multiples of half the distance between its quartiles,
from its median. The deviation of characters per token counts times the square root of the words, up to a number, as short
texts vary more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import map_batches, materialize, slices, small
from evidentia.llm.vocab import TOKENIZER_DIR, model_bytes

_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: First code points of ranges, and the script of each range.
_SCRIPTS = ((0x0, "Other"), (0x41, "Latin"), (0x5B, "Other"), (0x61, "Latin"), (0x7B, "Other"), (0xC0, "Latin"), (0x250, "Other"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"))
_STARTS, _NAMES = np.array([s for s, _ in _SCRIPTS]), sorted({n for _, n in _SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in _SCRIPTS], np.uint8)[np.searchsorted(_STARTS, np.arange(1 << 16), side="right") - 1]
FIGURES = ("chars_per_token", "byte_share", "entropy")


@dataclass(frozen=True)
class FertilityParams:
    """min_words, max_repeat_percent: base rules. lower, upper: limits of each of FIGURES in halves of the
    distance between quartiles, tried on labelled rows. floor_share: the least such half as a share of
    the median. steady_words: from so many words on, characters per token vary no less. min_docs: a language with fewer documents
    is judged by the band of all documents in its dominant script, a script with fewer by that of all documents."""

    min_words: int = 50
    max_repeat_percent: int = 50
    lower: tuple[float | None, ...] = (5.0, None, 7.0)
    upper: tuple[float | None, ...] = (6.0, 4.0, 7.0)
    floor_share: float = 0.005
    steady_words: int = 400
    min_docs: int = 20


def dominant_script(text: str) -> str:
    """Script of most letters; Other where there are none, the first name in a tie."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_SCRIPT_OF[np.minimum(codes, 0xFFFF)], minlength=len(_NAMES))
    n[_NAMES.index("Other")] = 0
    return _NAMES[int(n.argmax())] if n.any() else "Other"


def base_figures(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = sum(map(len, words)) - sum(map(len, (w.translate(None, _STARTING) for w in words if not w.isascii())))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeats = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            inside = np.zeros(len(words), bool)
            for k in range(3):
                inside[k : k + len(windows)] |= again
            repeats = int(inside.sum())
    return chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats


#: Bytes that begin a code point; what is left of a word without them are the others.
_STARTING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


class _Encoder:
    """Token ids of words; those of the words of one batch are kept."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])

    def batch(self, texts: list[list[bytes]]) -> Iterator[tuple[float, float, float]]:
        """chars_per_token, byte_share, entropy of each; None, 0 and None without a word."""
        index = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
        decoded = [w.decode("utf-8", "surrogatepass").encode("utf-8", "replace").decode() for w in index]
        ids = self.sp.encode(decoded, num_threads=1) if decoded else []
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.concatenate([[0], np.cumsum(n)])
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        n_chars = np.fromiter(map(len, decoded), np.int64, len(decoded))
        for words in texts:
            if not words:
                yield None, 0.0, None
                continue
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            size = n[at]
            total = int(size.sum())
            ends = np.cumsum(size)
            mine = flat[np.arange(total) + np.repeat(starts[at] - (ends - size), size)]
            counts = np.bincount(mine)
            p = counts[counts > 0] / total
            most = np.log2(total)
            yield float(n_chars[at].sum() / total), float(self.is_byte[mine].sum() / total), float(-(p * np.log2(p)).sum() / most) if total > 1 else 0.0


def measure(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, lang (null for an empty one), script and all figures of each whole text; a null text counts as one without words."""
    model = model_bytes(tokenizer_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(model)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            base = np.array([base_figures(t, w) for t, w in zip(texts, words, strict=True)], np.int64).reshape(-1, 4)
            token = list(zip(*encoder.batch(words), strict=True)) or [()] * 3
            scripts = pa.array([dominant_script(t) for t in texts], pa.string())
            out = {"doc_id": b.column("doc_id"), "lang": pa.array([x or None for x in b.column("lang").to_pylist()], pa.string()), "script": scripts, "n_words": pa.array([len(w) for w in words], pa.int64())}
            out |= {c: pa.array(base[:, k]) for k, c in enumerate(("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(v, pa.float64()) for c, v in zip(FIGURES, token, strict=True)})

    schema = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, entropy double"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", "lang"), run, schema)


def _deviation(c: str, p: FertilityParams):
    if c == "entropy":
        return F.col(c) - (F.col("entropy_at") + F.col("entropy_by") * F.ln(F.greatest("n_words", F.lit(1))))
    d = F.col(c) - F.col(f"mid_{c}")
    return d * F.sqrt(F.least(F.col("n_words"), F.lit(p.steady_words)) / p.steady_words) if c == "chars_per_token" else d


def _names():
    """A document's bands, the narrowest first; null where it has no language."""
    return [F.concat(F.lit("language "), "lang"), F.concat(F.lit("script "), "script"), F.lit("all")]


def bands(measured: DataFrame, params: FertilityParams = FertilityParams()) -> DataFrame:
    """Per language, per script, and for all documents that pass the base rules: band, n_docs, mid_ of each figure, entropy's
    course (entropy_at, entropy_by), and lo_ and hi_ of each figure's deviation."""
    p = params
    # three rows of a few numbers per document; the aggregates combine before the shuffle
    sound = measured.where("not base_failed").withColumn("band", F.explode(F.array_compact(F.array(*_names()))))
    length = F.ln(F.greatest("n_words", F.lit(1)))
    course = [F.coalesce(F.regr_slope("entropy", length), F.lit(0.0)).alias("entropy_by"), F.coalesce(F.regr_intercept("entropy", length), F.avg("entropy")).alias("entropy_at")]
    middle = materialize(sound.groupBy("band").agg(F.count("*").alias("n_docs"), *course, *[F.percentile_approx(c, 0.5, 2000).alias(f"mid_{c}") for c in FIGURES]), "medians")
    given = [c for c in middle.columns if c != "band"]
    spread = sound.join(small(middle), "band").groupBy("band", *given).agg(*[F.percentile_approx(_deviation(c, p), [0.25, 0.75], 2000).alias(c) for c in FIGURES])
    reach = lambda c: F.greatest((F.col(c)[1] - F.col(c)[0]) / 2, p.floor_share * F.col(f"mid_{c}"), F.lit(0.005))
    lo = [(-low * reach(c)).alias(f"lo_{c}") for c, low in zip(FIGURES, p.lower, strict=True) if low is not None]
    hi = [(high * reach(c)).alias(f"hi_{c}") for c, high in zip(FIGURES, p.upper, strict=True) if high is not None]
    return spread.select("band", *given, *lo, *hi)


def with_band(measured: DataFrame, limits: DataFrame, params: FertilityParams) -> DataFrame:
    """Each document with the limits of the narrowest of its bands that has min_docs documents, or of all."""
    values = F.struct(*limits.columns)
    wide = limits.where((F.col("n_docs") >= params.min_docs) | (F.col("band") == "all"))
    out = measured
    for k, name in enumerate(_names()):
        own = small(wide.select(F.col("band").alias(f"name_{k}"), values.alias(f"limits_{k}")))
        out = out.withColumn(f"key_{k}", name).join(own, F.col(f"key_{k}") == F.col(f"name_{k}"), "left").drop(f"key_{k}", f"name_{k}")
    parts = [f"limits_{k}" for k in range(3)]
    return out.withColumn("limits", F.coalesce(*parts)).drop(*parts).select("*", "limits.*").drop("limits", "n_docs")


def judge(docs: DataFrame, params: FertilityParams = FertilityParams(), tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Per document: doc_id, n_words and the base figures, base_failed, kept, the token figures and the band's name.

    Needs doc_id, text, lang; other columns are ignored. A null or empty text has no words and fails the base rules. Repeated
    rows are judged alike. A high entropy or a high number of characters per token is as suspect as a low one, a low byte
    share isn't. Where no document passes the base rules, there is no band and none is kept.
    """
    p = params
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    measured = materialize(measure(docs, tokenizer_dir).withColumn("base_failed", failed), "fertility")
    limits = materialize(bands(measured, p), "bands")
    ok = F.lit(True)
    for c, low, high in zip(FIGURES, p.lower, p.upper, strict=True):
        if low is not None:
            ok = ok & (_deviation(c, p) >= F.col(f"lo_{c}"))
        if high is not None:
            ok = ok & (_deviation(c, p) <= F.col(f"hi_{c}"))
    out = with_band(measured, limits, p).withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FIGURES, "band")
