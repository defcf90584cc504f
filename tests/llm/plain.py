"""Plain Python versions of operators, by loops over rows and words."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from evidentia.llm import fingerprint, sentencepiece_scan


def plain_word_hash(word):
    base, m = 0x9E3779B97F4A7C15, (1 << 64) - 1
    x = sum(c * pow(base, i, 1 << 64) for i, c in enumerate(word)) & m ^ len(word)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_cuts(text, window):
    """Words with the white space after them (before the first one, too), places after sentences, and after pieces, by the rule of the docstring, word by word."""
    data = text.encode()
    words = list(re.finditer(rb"[^\t\n\x0b\x0c\r ]+", data))
    h = [plain_word_hash(w[0].lower()) for w in words]
    cuts = {max(j for j in range(i, i + window) if h[j] == min(h[i : i + window])) for i in range(len(h) - window + 1)}
    parts, sentences, pieces, start = [], [], [], 0
    for k, w in enumerate(words):
        after = words[k + 1].start() if k + 1 < len(words) else len(data)
        ends = w[0][-1:] in (b".", b"!", b"?") or b"\n" in data[w.end() : after] or k + 1 == len(words)
        sentences += [k + 1] * ends
        pieces += [k + 1] * (ends or k in cuts)
        parts.append(data[start:after].decode())
        start = after
    return parts, sentences, pieces


def plain_sentences(text):
    parts, ends, _ = plain_cuts(text, 4)
    return ["".join(parts[i:j]) for i, j in zip([0, *ends], ends)] or [text] * bool(text)


def plain_runs(ends, parts, words):
    """First word and end of the shortest runs from each place on, and to each place."""
    at, found = [0, *ends], set()
    for i in range(len(at)):
        onward = next((j for j in range(i + parts, len(at)) if at[j] - at[i] >= words), None)
        back = next((j for j in range(i - parts, -1, -1) if at[i] - at[j] >= words), None)
        found |= {(at[i], at[onward])} if onward is not None else set()
        found |= {(at[back], at[i])} if back is not None else set()
    return found


def plain_spans(rows, p):
    """Per (doc_id, text), in order of doc_id: the text left, sentences and those that lost a word."""
    out, seen = {}, {}
    for i, text in rows:
        parts, sentences, pieces = plain_cuts(text or "", p.window)
        words = [x.encode().lower().split()[0] for x in parts]
        gone = set()
        for a, b in sorted(plain_runs(sentences, p.sentences, p.words) | plain_runs(pieces, 1, p.long)):
            doc, end = seen.setdefault(tuple(words[a:b]), (i, b))
            if doc != i or a >= end:
                gone |= set(range(a, b))
        lost = sum(any(k in gone for k in range(a, b)) for a, b in zip([0, *sentences], sentences))
        left = "".join(x for k, x in enumerate(parts) if k not in gone) if parts else text
        out[i] = None if text is None else left, len(sentences) or int(bool(text)), lost
    return out


def plain_components(texts, size, num):
    """Of {doc_id: text}: the component and the number of word runs of each."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def plain_copies(tokens, path, p):
    """Of {doc_id: tokens} and {doc_id: leaf}: how often the mixture holds each."""
    weight = lambda level, v: p.weights.get(p.levels[level], {}).get(v, 1)
    supply = Counter()
    for i, leaf in path.items():
        supply[leaf] += tokens[i]
    able = {leaf: s * p.max_epochs if all(weight(k, v) for k, v in enumerate(leaf)) else 0 for leaf, s in supply.items()}

    def share(prefix, budget):
        if len(prefix) == len(p.levels):
            return {prefix: int(budget)}
        kids = sorted({leaf[: len(prefix) + 1] for leaf in able if leaf[: len(prefix)] == prefix})
        cap = {k: sum(v for leaf, v in able.items() if leaf[: len(k)] == k) for k in kids}
        left, open_, given = budget, [k for k in kids if cap[k] > 0], {}
        while open_:
            rate = left / sum(weight(len(prefix), k[-1]) for k in open_)
            full = [k for k in open_ if cap[k] <= rate * weight(len(prefix), k[-1])]
            if not full:
                given |= {k: rate * weight(len(prefix), k[-1]) for k in open_}
                break
            for k in full:
                given[k] = cap[k]
                left -= cap[k]
            open_ = [k for k in open_ if k not in full]
        out = {}
        for k in given:
            out |= share(k, given[k])
        return out

    budgets = share((), min(sum(able.values()), sum(supply.values()) * p.budget_percent // 100))
    expected = {}
    for leaf, s in supply.items():
        epochs, rest = divmod(budgets.get(leaf, 0), s) if s else (0, 0)
        order = sorted((int(hashlib.md5(f"{p.seed}:{epochs + 1}:{i}".encode()).hexdigest()[:8], 16), i) for i in path if path[i] == leaf)
        total, more = 0, True
        for _, i in order:
            total += tokens[i]
            more = more and total <= rest and rest > 0
            expected[i] = epochs + more
    return expected


def plain_ids(text):
    """Best segmentation of the whole text as one sequence."""
    e = sentencepiece_scan.encoder(sentencepiece_scan.model_bytes())
    if not text:
        return []
    t = " " + text
    n = len(t)
    best, back = [0] + [None] * n, [0] * (n + 1)
    for q in range(n):
        for end in range(q + 1, min(q + e.longest, n) + 1):
            s = e.score.get(t[q:end], e.unknown if end == q + 1 else None)
            if s is not None and (best[end] is None or best[q] + s > best[end]):
                best[end], back[end] = best[q] + s, q
    out, at = [], n
    while at:
        out = e.ids_of(t, back[at], at) + out
        at = back[at]
    return out


def plain_fingerprint(text, bins=256):
    """The fingerprint by loops: lists of the bins' low bits, empty without a word."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed

    eight, four = (lambda v: (v % (1 << 64)).to_bytes(8, "little")), (lambda v: v.to_bytes(4, "little"))
    words = [chain([w.encode()]) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    smallest = {}
    for i in range(max(1, len(words) - 4) if words else 0):
        h = chain(map(eight, words[i : i + 5]))
        smallest[h % bins] = min(smallest.get(h % bins, 1 << 64), h >> 8)
    order = sorted(smallest, key=lambda b: signed(b << 56))
    out = []
    for b in range(bins if smallest else 0):
        tries = [b] + [chain([eight(b), four(i)]) % bins for i in range(fingerprint.PROBES)]
        at = next((x for x in tries if x in smallest), None)
        if at is None:
            at = min(order, key=lambda x: signed(chain([eight(b), eight(signed(x << 56) >> 56 & 255)]) & ~255))
        out.append(smallest[at] & 15)
    return out


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows, period=20, heads=4):
    """Of (conv_id, turn, role, text): the trie's rows, by walking over all prefixes."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    turns = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    built = {}
    for c, s in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = turns.get(c - c % period, [])[:h] + s[h:]
    members, end, kids, leaves, saved = (defaultdict(list), defaultdict(list), defaultdict(list), Counter(), Counter())
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        end[tuple(built[c])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * (len(_WORD.findall(p[-1][1])) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, end[p])).encode()).hexdigest()
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], sha(p)) for p in members)
