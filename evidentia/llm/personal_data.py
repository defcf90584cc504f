"""Personal data in texts: forms that rules know, and further mentions that a skip-chain conditional random field finds.

The rules give emails, IP addresses, payment cards and phone numbers as they are usually written. The field looks at words with digits,
an at sign or one spelt out, and at their neighbours. Adjacent words share a potential of their labels, and so do distant words of a
document that are the same or similar: the same signs once separators are dropped, or the same last digits. So a number that stands alone
is told by another place where it stands in full. Labels of the rules' spans are given; those of other words come from loopy
sum-product messages over the whole document. All other words have no label, which cuts the chain exactly there.

Same and similar words are linked one after another, not in pairs. Weights are learned from texts that a seeded generator writes, as no
table has labels for single words: by pseudo-likelihood first, then by the likelihood that messages give.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import map_batches, slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign to the left as far as signs of a name go, and not into the match before."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = domain.end() if domain else at + 1
        if domain:
            yield start, low
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the rules' matches, leftmost and not overlapping within a kind, by start and kind."""
    found = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts[i : i + 4]):
                    found.append((1, at, end))
                at = end + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(found, key=lambda x: (x[1], x[0]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


# --- words and what is known of them

_AT_WORD = re.compile(r"[\[({<]{1,2} ?(?:at|arroba|chez) ?[\])}>]{1,2}", re.IGNORECASE)
_DOT_WORD = re.compile(r"[\[({<]{1,2} ?(?:dot|punkt|point|punto|\.) ?[\])}>]{1,2}", re.IGNORECASE)
#: Words before a mention that tell its kind.
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "adresse", "client"},
    "card": {"card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"},
    "phone": {"tel", "phone", "call", "telephone", "fax", "mobile", "cell", "telefon", "tél", "téléphone", "teléfono", "móvil", "handy", "portable", "whatsapp"},
}
_CUE_OF = {w: k for k, name in enumerate(KINDS) for w in CUES[name]}
_SHAPES = tuple(
    re.compile(x)
    for x in (
        r"[^@\s]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\W?$", r"\W?[0-9]{1,3}(?:\W{1,3}[0-9]{1,3}){3}\W?$", r"\W?[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}\W?$", r"\W?\+", r"\(0?[0-9]{2,5}\)\W?$",
        r"\W?0?[0-9]{2,5}(?:[-./][0-9]{2,5}){1,3}\W?$", r"\W?[0-9]{4}\W?$", r"\W?(?:[0-9]{4}[./:_-]){2,4}[0-9]{1,4}\W?$", r"\W?[xX*#.]{2,}-?[0-9]{2,4}\W?$", r"\W?[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}\W?$",
        r"\W?[0-9]{1,2}:[0-9]{2}", r"\W?[0-9]+[.,][0-9]{1,2}\W?$|[$€£]", r"\W?[vV][0-9]", r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_]+\W?$",
    )
)
_LENGTHS = (1, 3, 5, 7, 8, 9, 12, 13, 17, 20)
_OWN = 4 + len(_SHAPES) + len(_LENGTHS) + 2
_ABOUT = 2 * (len(_LENGTHS) + 4)
N_FEATURES = _OWN + _ABOUT + len(KINDS)
#: Signs of a word that the shapes look at: longer ones have no shape.
_LONGEST = 80


def _own(word: str) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
    """The word's own features, what its neighbours learn of it, and the kind of which it is a cue (-1: none)."""
    digits = only_digits(word)
    size = int(np.searchsorted(_LENGTHS, len(digits), side="right")) - 1
    at, dot = _AT_WORD.fullmatch(word) is not None, _DOT_WORD.fullmatch(word) is not None
    inner = not at and _AT_WORD.search(word) is not None
    on = [0] + ([1] if at else []) + ([2] if dot else []) + ([3] if inner else [])
    if len(word) <= _LONGEST:
        on += [4 + i for i, shape in enumerate(_SHAPES) if shape.match(word)]
    here = 4 + len(_SHAPES)
    if size >= 0:
        on.append(here + size)
    here += len(_LENGTHS)
    if 12 <= len(digits) <= 19 and luhn(digits):
        on.append(here)
    if "@" in word:
        on.append(here + 1)
    seen = [0 if at else 1 if inner or "@" in word else 2 if dot else 3 if size < 0 else 4 + size]
    bare = word.strip(".,:;!?()[]\"'#").lower() if size < 0 and len(word) < 20 else ""
    return tuple(on), _CUE_OF.get(bare, -1), tuple(seen)


@dataclass
class Graph:
    """Nodes of documents: features (indexes, padded by -1), given labels (-1: none), document and place of each, and its word's start
    and end; edges as two nodes and a type."""

    features: np.ndarray
    given: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    edges: np.ndarray


#: Types of edges: neighbours, the same signs, the same last seven digits, the same last four digits of which one word is masked.
EDGES = 4
LABELS = 1 + len(KINDS)
_WIDTH = 24


def _keys(word: str) -> list[tuple[int, str]]:
    """What makes words the same or similar: pairs of an edge type and a key."""
    if len(word) > _LONGEST:
        return []
    digits = only_digits(word)
    if "@" in word or _AT_WORD.search(word):
        plain = _DOT_WORD.sub(".", _AT_WORD.sub("@", word)).strip(".,:;!?()[]<>\"'").lower()
        return [(1, plain)]
    found = [(1, digits)] if len(digits) >= 5 else []
    if len(digits) >= 7:
        found.append((2, digits[-7:]))
    if len(digits) >= 12 or (2 <= len(digits) <= 4 and _SHAPES[8].match(word)):
        found.append((3, digits[-4:]))
    return found


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word that may be part of a mention or stands beside one, and its number among all words."""
    none = np.zeros(0, np.int64)
    cues = [m.start() for m in _AT_WORD.finditer(text)] if "at" in text or "AT" in text or "arroba" in text or "chez" in text else []
    if not cues and "@" not in text and not _DIGIT.search(text):
        return none, none, none
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.concatenate([[True], (codes == 32) | ((codes >= 9) & (codes <= 13)), [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    start, end = turns[::2], turns[1::2]
    cues += [m.start() for m in _DOT_WORD.finditer(text)] if cues else []
    marks = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    at = np.searchsorted(start, np.concatenate([marks, np.array(cues, np.int64)]), side="right") - 1
    active = np.unique(at)
    near = np.unique(np.concatenate([active - 1, active, active + 1]))
    near = near[(near >= 0) & (near < len(start))]
    return start[near], end[near], near


class _Known(dict):
    def __missing__(self, word: str):
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = _own(word), _keys(word)
        return found


_KNOWN = _Known()


def graph(texts: list[str], bases: list[list[Span]]) -> Graph:
    """The nodes and edges of some whole texts."""
    rows: list[tuple[np.ndarray, ...]] = []
    features, edges, total = [], [], 0
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        start, end, place = _words(text)
        n = len(start)
        if not n:
            continue
        given = np.full(n, -1)
        for kind, s, e in base:
            given[np.searchsorted(end, s, side="right") : np.searchsorted(start, e)] = 1 + kind
        known = [_KNOWN[text[s:e]] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        f = np.full((n, _WIDTH), -1, np.int16)
        beside = np.flatnonzero(np.diff(place) == 1)
        for i, ((on, _, _), _) in enumerate(known):
            f[i, : min(len(on), 18)] = on[:18]
        seen = np.array([k[0][2][0] for k in known], np.int16)
        cue = np.array([k[0][1] for k in known], np.int16)
        f[beside + 1, 18] = _OWN + seen[beside]
        f[beside, 19] = _OWN + _ABOUT // 2 + seen[beside + 1]
        for back in (1, 2, 3):  # a cue a few words before, through words beside each other
            ok = np.zeros(n, bool)
            ok[back:] = place[back:] - place[:-back] == back
            told = np.full(n, -1, np.int16)
            told[back:] = cue[:-back]
            told[~ok] = -1
            f[told >= 0, 19 + back] = _OWN + _ABOUT + told[told >= 0]
        features.append(f)
        rows.append((given, np.full(n, d), place, start, end))
        edges.append(np.stack([beside + total, beside + total + 1, np.zeros(len(beside), np.int64)]))
        last: dict[tuple[int, str], int] = {}
        skips = []
        for i, (_, keys) in enumerate(known):
            for key in keys:
                if key in last:
                    skips.append((last[key] + total, i + total, key[0]))
                last[key] = i
        if skips:
            edges.append(np.array(skips).T)
        total += n
    if not rows:
        none = np.zeros(0, np.int64)
        return Graph(np.zeros((0, _WIDTH), np.int16), none, none, none, none, none, np.zeros((3, 0), np.int64))
    cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
    return Graph(np.concatenate(features), *cols, np.concatenate(edges, axis=1))


@dataclass(frozen=True)
class Field:
    """weights: of features by label. pairs: log potentials by edge type and both labels."""

    weights: np.ndarray
    pairs: np.ndarray

    def local(self, features: np.ndarray) -> np.ndarray:
        padded = np.concatenate([self.weights, np.zeros((1, LABELS))])
        out = np.zeros((len(features), LABELS))
        for c in range(features.shape[1]):
            out += padded[features[:, c]]
        return out


_GIVEN = 60.0


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def _messages(g: Graph, field: Field, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Log beliefs of nodes, and the log messages along all edges, then against them."""
    local = field.local(g.features)
    fixed = g.given >= 0
    local[fixed] = -_GIVEN
    local[fixed, g.given[fixed]] = 0.0
    a, b, kind = g.edges
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    m, n = len(a), len(local)
    potentials = np.exp(field.pairs)
    groups = [(np.flatnonzero(kind == t), potentials[t]) for t in range(EDGES)]
    groups = [x for i, p in groups if len(i) for x in ((i, p), (i + m, p.T))]
    reverse = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    sent = np.zeros((2 * m, LABELS))
    belief = local
    for r in range(rounds if m else 0):
        out = belief[source] - sent[reverse]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.empty_like(sent)
        for i, p in groups:
            new[i] = np.log(out[i] @ p + 1e-300)
        new -= _log_sum(new)
        if r >= 10:
            new = (new + sent) / 2
        change = np.abs(np.exp(new) - np.exp(sent)).max()
        sent = new
        belief = local + np.stack([np.bincount(target, sent[:, y], minlength=n) for y in range(LABELS)], axis=1)
        if change < tolerance:
            break
    return belief, sent


def marginals(g: Graph, field: Field, rounds: int = 100, tolerance: float = 1e-4) -> np.ndarray:
    """Each node's probabilities of labels: sum-product messages along all edges both ways at once, until they change little or after
    so many rounds. Messages are damped by half once ten rounds haven't settled them. On a tree they are exact."""
    belief, _ = _messages(g, field, rounds, tolerance)
    return np.exp(belief - _log_sum(belief))


# --- learning

_SYLLABLES = "ba be ca da de el en er fa ga he in ka la le lo ma mi na no on or pa ra re ri sa se ta te ti to ul un ve".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, 14)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _entity(r: random.Random) -> tuple[int, list[str], list[str]]:
    """A kind, its usual forms, which the rules find, and other forms."""
    kind = r.randrange(len(KINDS))
    if kind == 0:
        name, host, end = _name(r) + r.choice(["", ".", "_"]) + _digits(r, r.choice([0, 1, 2])), _name(r), r.choice(["com", "org", "net", "de", "fr"])
        name = name.rstrip("._") or "x"
        return kind, [f"{name}@{host}.{end}"], [f"{name}[at]{host}.{end}", f"{name} [at] {host} [dot] {end}", f"{name}(at){host}(dot){end}", f"{name} (at) {host}.{end}", f"{name} [AT] {host}.{end}"]
    if kind == 1:
        parts = [str(r.randrange(1, 256)) for _ in range(4)]
        six = ":".join(f"{r.randrange(65536):x}" for _ in range(8))
        return kind, [".".join(parts)], ["[.]".join(parts), f"{'.'.join(parts[:3])}[.]{parts[3]}", "(.)".join(parts), six, six]
    if kind == 2:
        d = _card(r)
        four = [d[i : i + 4] for i in range(0, 16, 4)]
        return kind, [d, " ".join(four), "-".join(four)], [".".join(four), "/".join(four), f"xxxx{d[-4:]}", f"****{d[-4:]}", f"****-{d[-4:]}", ":".join(four), "_".join(four)]
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return kind, [f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"+33 {a}{b}{c}"], [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a}/{b}{c}", f"{a}.{b}.{c}", f"0{a}-{b}{c}", f"{b}-{c}", f"0{a} {b}{c}", f"{a}{b}{c}"]


def _name(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice([2, 3])))


def _decoy(r: random.Random) -> str:
    """Digits that aren't personal data."""
    return r.choice(
        [
            lambda: _digits(r, r.choice([1, 1, 2, 2, 3, 4, 4, 5, 6, 7, 8, 10, 11])), lambda: f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1900, 2030)}", lambda: f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}",
            lambda: f"{r.randrange(24)}:{r.randrange(60):02}", lambda: f"{r.randrange(1, 9000)}.{r.randrange(100):02}", lambda: f"${r.randrange(1, 9000)}", lambda: f"v{r.randrange(9)}.{r.randrange(30)}", lambda: f"{r.randrange(16**8):08x}",
            lambda: f"{r.randrange(100)}%", lambda: f"{_name(r)}{_digits(r, 2)}", lambda: f"({r.randrange(1, 99)})", lambda: f"{r.randrange(1, 200)}-{r.randrange(200, 400)}", lambda: f"{_digits(r, 3)}-{_digits(r, 2)}", lambda: "@" + _name(r),
            lambda: f"{r.randrange(16**20):040x}", lambda: next(d for d in iter(lambda: _digits(r, r.choice([13, 15, 16, 18])), "") if not luhn(d)), lambda: f"978-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}",
            lambda: f"{_digits(r, 3)} {_digits(r, 3)}", lambda: f"{_digits(r, 7)}", lambda: f"{_digits(r, 10)}", lambda: f"[{r.randrange(1, 60)}]", lambda: f"{_digits(r, 1)}.{_digits(r, 1)}.{_digits(r, 2)}", lambda: f"#{_digits(r, 6)}", lambda: f"[.] {_digits(r, 2)}",
        ]
    )()


def written(seed: int, docs: int) -> tuple[list[str], list[list[Span]]]:
    """Texts with mentions in usual and other forms, some of them of one thing twice, among words and other digits; and all mentions."""
    r = random.Random(seed)
    texts, truths = [], []
    for _ in range(docs):
        pieces: list[tuple[str, int]] = []
        for _ in range(r.randrange(1, 4)):
            kind, usual, other = _entity(r)
            # a number without any form of its own is told by the full one or by a cue
            vague = [x for x in other if kind in (2, 3) and re.fullmatch(r"[0-9-]{7,8}|[0-9]{10}|0[0-9]{3}.[0-9]{7}|[x*]{4}-?[0-9]{4}", x)]
            plain = [x for x in other if x not in vague]
            forms = r.choice([[r.choice(usual)], [r.choice(usual), r.choice(other)], [r.choice(usual), r.choice(vague or other)], [r.choice(usual), r.choice(usual)], [r.choice(plain)], [r.choice(other)], [r.choice(plain), r.choice(other)]])
            for x in forms:
                alone = len(forms) == 1 or forms[0] in vague
                cue = r.choice(sorted(CUES[KINDS[kind]])) if x in vague and alone or r.random() < 0.3 else None
                pieces.append((f"{cue}{r.choice([':', '', ''])}" if cue else "", -1))
                pieces[-1] = (pieces[-1][0] + "\0" + x, kind)
        pieces += [(r.choice([_decoy(r), _decoy(r), r.choice(sorted(r.choice(list(CUES.values())))) + " " + _name(r)]), -1) for _ in range(r.randrange(0, 8))]
        r.shuffle(pieces)
        text, truth = "", []
        for x, kind in pieces:
            text += " ".join(_name(r) + r.choice(["", "", "", ",", "."]) for _ in range(r.randrange(0, 6))) + " "
            if kind >= 0:
                cue, x = x.split("\0")
                text += cue + " " * bool(cue)
                truth.append((kind, len(text), len(text) + len(x)))
            text += x + r.choice([" ", " ", ". ", ", ", "\n"])
        texts.append(text + _name(r))
        truths.append(truth)
    return texts, truths


def truth_labels(g: Graph, truths: list[list[Span]]) -> np.ndarray:
    """The label of each node's word."""
    out = np.zeros(len(g.doc), np.int64)
    first = np.searchsorted(g.doc, np.arange(len(truths) + 1))
    for d, truth in enumerate(truths):
        i, j = first[d], first[d + 1]
        for kind, s, e in truth:
            out[i + np.searchsorted(g.end[i:j], s, side="right") : i + np.searchsorted(g.start[i:j], e)] = 1 + kind
    return out


@dataclass(frozen=True)
class PersonalParams:
    """training_docs: texts that the generator writes. apart, whole: steps on words alone, and on whole texts. penalty: of squared weights, halved. least: the probability from which a word has a label."""

    training_docs: int = 700
    seed: int = 12
    apart: int = 120
    whole: int = 80
    penalty: float = 1.0
    least: float = 0.6


@lru_cache(maxsize=4)
def learn(p: PersonalParams = PersonalParams()) -> Field:
    """Weights of the greatest likelihood, penalised: first each word's labels given those at its edges' other ends (pseudo-likelihood),
    then all labels of a text at once, whose expected counts come from messages."""
    texts, truths = written(p.seed, p.training_docs)
    g = graph(texts, [base_spans(t) for t in texts])
    y = truth_labels(g, truths)
    n = len(y)
    x = np.zeros((n, N_FEATURES + 1))
    x[np.arange(n)[:, None], g.features] = 1.0
    x = x[:, :N_FEATURES]
    a, b, kind = g.edges
    # how many edges of each type lead to a label, each way
    around = np.zeros((n, 2 * EDGES * LABELS))
    np.add.at(around, (a, kind * LABELS + y[b]), 1.0)
    np.add.at(around, (b, EDGES * LABELS + kind * LABELS + y[a]), 1.0)
    free = g.given < 0
    x, around, target = x[free], around[free], np.eye(LABELS)[y[free]]
    w, pairs = np.zeros((N_FEATURES, LABELS)), np.zeros((EDGES, LABELS, LABELS))
    moments = [np.zeros_like(v) for v in (w, w, pairs, pairs)]
    loose = free[a] | free[b]
    held = np.zeros((EDGES, LABELS, LABELS))
    np.add.at(held, (kind[loose], y[a[loose]], y[b[loose]]), 1.0)

    def apart() -> tuple[np.ndarray, np.ndarray]:
        z = x @ w + around @ np.concatenate([pairs.transpose(0, 2, 1).reshape(-1, LABELS), pairs.reshape(-1, LABELS)])
        z = np.exp(z - z.max(axis=1, keepdims=True))
        miss = z / z.sum(axis=1, keepdims=True) - target
        back = (around.T @ miss).reshape(2, EDGES, LABELS, LABELS)
        return x.T @ miss, back[0].transpose(0, 2, 1) + back[1]

    def whole() -> tuple[np.ndarray, np.ndarray]:
        belief, sent = _messages(g, Field(w, pairs), 30, 1e-3)
        m = len(a)
        left, right = belief[a[loose]] - sent[m:][loose], belief[b[loose]] - sent[:m][loose]
        both = np.exp(left - left.max(axis=1, keepdims=True))[:, :, None] * np.exp(right - right.max(axis=1, keepdims=True))[:, None, :] * np.exp(pairs)[kind[loose]]
        both /= both.sum(axis=(1, 2), keepdims=True)
        expected = np.stack([both[kind[loose] == t].sum(axis=0) for t in range(EDGES)])
        return x.T @ (np.exp(belief - _log_sum(belief))[free] - target), expected - held

    for step in range(1, p.apart + p.whole + 1):
        slopes = apart() if step <= p.apart else whole()
        for v, s, k in ((w, slopes[0], 0), (pairs, slopes[1], 2)):
            s = (s + p.penalty * v) / len(target)
            moments[k] = 0.9 * moments[k] + 0.1 * s
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * s * s
            v -= 0.1 * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(w, pairs)


_QUAD = re.compile(r"([0-9]{1,3})\W{1,3}([0-9]{1,3})\W{1,3}([0-9]{1,3})\W{1,3}([0-9]{1,3})")
_SIX = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")


def sound(kind: int, text: str) -> bool:
    """Whether what was found has what its kind needs."""
    digits = only_digits(text)
    if kind == 0:
        return text.count("@") + len(_AT_WORD.findall(text)) == 1
    if kind == 1:
        m = _QUAD.fullmatch(text)
        return all(int(v) <= 255 for v in m.groups()) if m else _SIX.fullmatch(text) is not None
    if kind == 2:
        return 12 <= len(digits) <= 19 or _SHAPES[8].match(text) is not None
    return 7 <= len(digits) <= 15 and ":" not in text


#: Words of a mention at most.
_WORDS = 8


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without the signs around a mention."""
    while s < e and not (text[s].isalnum() or text[s] in "+(*" and e - s > 1):
        s += 1
    while s < e and not text[e - 1].isalnum():
        e -= 1
    return s, e


def further_spans(texts: list[str], bases: list[list[Span]], field: Field, least: float) -> list[list[Span]]:
    """Runs of words of one label that the field is sure of and no rule has found, without the signs around them."""
    g = graph(texts, bases)
    found: list[list[Span]] = [[] for _ in texts]
    if not len(g.doc):
        return found
    p = marginals(g, field)
    label = np.where((p.max(axis=1) >= least) & (g.given < 0), p.argmax(axis=1), 0)
    starts = np.flatnonzero(label > 0)
    if not len(starts):
        return found
    on = (np.diff(starts) == 1) & (np.diff(g.doc[starts]) == 0) & (np.diff(g.place[starts]) == 1) & (np.diff(label[starts]) == 0)
    first = starts[np.concatenate([[True], ~on])]
    last = starts[np.concatenate([~on, [True]])]
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        text, kind = texts[g.doc[i]], int(label[i]) - 1
        while i <= j:
            for k in range(min(j, i + _WORDS - 1), i - 1, -1):  # the longest sound mention from here
                s, e = _trimmed(text, int(g.start[i]), int(g.end[k]))
                if s < e and sound(kind, text[s:e]):
                    found[g.doc[i]].append((kind, s, e))
                    i = k
                    break
            i += 1
    return found


def find(docs: DataFrame, params: PersonalParams = PersonalParams()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans (the rules' and the field's).

    A null text counts as empty, and has no spans; repeated rows get the same result each; other columns are ignored; an empty table
    gives an empty result; a row without doc_id is a text like others. Whole texts are read, in time linear in their length.
    """
    field, least = learn(params), params.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = further_spans(texts, bases, field, least)
            counts = np.array([[sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))] for base in bases], np.int64).reshape(len(texts), len(KINDS))
            cols = {"doc_id": b.column("doc_id")} | {f"n_{name}": pa.array(counts[:, i]) for i, name in enumerate(KINDS)}
            cols["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base in bases], pa.string())
            cols["spans"] = pa.array([joined(sorted(base + extra, key=lambda x: (x[1], x[0]))) for base, extra in zip(bases, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, " + ", ".join(f"n_{name} long" for name in KINDS) + ", base_sha256 string, spans string"
    return map_batches(docs.select("doc_id", "text"), run, schema)
