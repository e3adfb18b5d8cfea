"""Plain versions of the operators, pair by pair and row by row, for small fixtures. They share no code with the package."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

M64 = (1 << 64) - 1


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def classes(items, alike):
    """item -> smallest item that it is connected with."""
    items = sorted(items)
    parent = {x: x for x in items}
    for a, b in itertools.combinations(items, 2):
        if alike(a, b):
            x, y = sorted((find(parent, a), find(parent, b)))
            parent[y] = x
    return {x: find(parent, x) for x in items}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_alike(a, b, least=24, edits=2):
    return a == b != "" if min(len(a), len(b)) < least else abs(len(a) - len(b)) <= edits and distance(a, b) <= edits


def without_repeated_lines(docs):
    """docs: {doc_id: text}; the texts that are left, first lines by (doc_id, line)."""
    places = [(i, n, line) for i, t in sorted(docs.items()) for n, line in enumerate((t or "").split("\n"))]
    of = classes({x[2].strip(" ") for x in places}, lines_alike)
    seen, left, cut = set(), defaultdict(list), set()
    for i, _, line in places:
        own = of[line.strip(" ")]
        if own and own in seen:
            cut.add(i)
        else:
            seen.add(own)
            left[i].append(line)
    return {i: docs[i] if i not in cut else "\n".join(left[i]) for i in docs if i not in cut or "\n".join(left[i])}


def bag(text):
    # a word: letters, digits, underscores and all beyond ASCII
    words = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 0))) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def near(a, b, threshold=0.8):
    both = sum((a & b).values())
    return bool(a) and bool(b) and both / (sum(a.values()) + sum(b.values()) - both) >= threshold


def near_duplicate_heads(docs):
    """docs: {doc_id: text}; doc_id -> smallest doc_id of its class."""
    bags = {i: bag(t) for i, t in docs.items()}
    return classes(docs, lambda a, b: near(bags[a], bags[b]))


class Bayes:
    """Multinomial naive Bayes over hashed 1- to 3-grams."""

    def __init__(self, rows, bits=15, smoothing=0.5):
        self.bits, rows = bits, {r for r in rows if r[0] is not None and r[1] is not None}
        self.docs, self.counts = Counter(label for _, label in rows), defaultdict(Counter)
        for text, label in rows:
            self.counts[label].update(self.grams(text))
        self.smooth, self.sums = smoothing, {k: sum(c.values()) + smoothing * (1 << bits) for k, c in self.counts.items()}

    def grams(self, text):
        own, before = [32], False
        for c in text.lower() + " ":
            if c.isalpha():
                own.append(ord(c))
            elif before:
                own.append(32)
            before = c.isalpha()
        for n in (1, 2, 3):
            for i in range(len(own) - n + 1):
                h = own[i] + n
                for k in range(1, n):
                    h = (h * 0x9E3779B97F4A7C15 + own[i + k]) & M64
                h = (h * 0xD6E8FEB86659FD93) & M64
                h ^= h >> 32
                yield ((h * 0xD6E8FEB86659FD93) & M64) >> (64 - self.bits)

    def predict(self, text):
        if not text or not any(c.isalpha() for c in text.lower()):
            return "und", 0.0
        total, grams = sum(self.docs.values()), Counter(self.grams(text))
        score = {k: math.log(self.docs[k] / total) + sum(n * math.log((self.counts[k][g] + self.smooth) / self.sums[k]) for g, n in grams.items()) for k in sorted(self.docs)}
        best = max(score, key=score.get)
        return best, 1 / sum(math.exp(s - score[best]) for s in score.values())


def exponent(have, target_entropy=None, most_repeats=None, budget=None):
    """have: tokens of each source. The smallest exponent whose mix keeps the limits, and its weights."""

    def weights(x):
        raw = [(n / sum(have)) ** x for n in have]
        return [r / sum(raw) for r in raw]

    def fits(x):
        w = weights(x)
        size = max(n / v for n, v in zip(have, w, strict=True)) if budget is None else budget
        spread = -sum(v * math.log(v) for v in w)
        return (target_entropy is None or spread <= target_entropy + 1e-12) and (most_repeats is None or max(v * size / n for n, v in zip(have, w, strict=True)) <= most_repeats + 1e-9)

    low, high = 0.0, 1.0
    if fits(0.0):
        return 0.0, weights(0.0)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high, weights(high)


def draws(rows, hash_of, **limits):
    """rows: (doc, source, n_tokens, ...) -> list of (row, pass, place, want). hash_of(row, pass): its place in the order of a pass."""
    have = Counter()
    for r in rows:
        have[r[1]] += r[2]
    names = list(have)
    _, weights = exponent([have[s] for s in names], **limits)
    size = limits.get("budget") or max(have[s] / w for s, w in zip(names, weights, strict=True))
    out = []
    for source, w in zip(names, weights, strict=True):
        want, number = w * size, 0
        while number * have[source] < want - 0.5:
            at = 0
            for r in sorted((r for r in rows if r[1] == source), key=lambda r: hash_of(r, number)):
                if number + 1 <= want / have[source] + 1e-9 or at < want - number * have[source]:
                    out.append((r, number, number * have[source] + at, want))
                at += r[2]
            number += 1
    return out, size


KINDS = [
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ("user", r"""(?ai:user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", lambda m: True),
    ("blob", r"[A-Za-z0-9+/]{32,}={0,2}", lambda m: all(re.search(p, m[0]) for p in ("[0-9]", "[A-Z]", "[a-z]"))),
    ("endpoint", r"""(?ai:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|s3)://[^\s"'<>]+""", lambda m: True),
]


def secrets(text, scope=400):
    """base and all spans as text."""
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m)]
    base = [x for x in found if x[1] < 3]
    weak = [x for x in found if x[1] >= 3 and not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    sort = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
    linked = []
    for w in weak:
        near_by = {sort[o[1]] for o in base + weak if o[0] <= w[2] + scope and o[2] >= w[0] - scope}
        if {3: "s" in near_by, 4: "i" in near_by, 5: {"i", "s"} <= near_by}[w[1]]:
            linked.append(w)
    told = lambda xs: ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(xs))
    return told(base), told(base + linked)
