"""Row-by-row versions of what the operators compute over tables."""

import math
import zlib

import numpy as np


class PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries and the textbook's sums, for one language."""

    def __init__(self, texts, alphabet, order=4):
        self.alphabet, self.order, self.counts = alphabet, order, {}
        grams = {}
        for t in texts:
            units = self.units(t)
            for i in range(len(units)):
                g = tuple(([" "] * order + units)[i + 1 : i + 1 + order])
                grams[g] = grams.get(g, 0) + 1
        self.counts[order] = grams
        for n in range(order - 1, 0, -1):
            kinds = {}
            for g in self.counts[n + 1]:
                kinds[g[1:]] = kinds.get(g[1:], 0) + 1
            self.counts[n] = kinds
        self.after, self.discount = {}, {}
        for n, counts in self.counts.items():
            n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            self.discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for g, c in counts.items():
                kinds, total = self.after.get(g[:-1], (0, 0))
                self.after[g[:-1]] = (kinds + 1, total + c)
        # A shorter context is another key than a longer one: tuples of different lengths never meet.

    @staticmethod
    def units(text):
        out = []
        for c in text or "":
            c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out.append(c)
        return out

    def p(self, n, gram):
        if n == 0:
            return 1 / self.alphabet
        if gram[:-1] not in self.after:
            return self.p(n - 1, gram[1:])
        d, (kinds, total) = self.discount[n], self.after[gram[:-1]]
        return max(self.counts[n].get(gram, 0) - d, 0) / total + d * kinds / total * self.p(n - 1, gram[1:])

    def entropy(self, text):
        units = self.units(text)
        padded = [" "] * self.order + units
        return sum(-math.log(self.p(self.order, tuple(padded[i + 1 : i + 1 + self.order]))) for i in range(len(units))) / len(units)


def median(values):
    v = sorted(values)
    return (v[len(v) // 2] + v[(len(v) - 1) // 2]) / 2


def languages(fitted, held_back, rows, shuffled, strictness=0.5):
    """Which rows a language is known for. fitted, held_back: (text, lang); five texts of each language or more are held back."""
    alphabet = len({u for t, _ in fitted for u in PlainKneserNey.units(t)}) + 1
    models = {x: PlainKneserNey([t for t, lang in fitted if lang == x], alphabet) for x in sorted({lang for _, lang in fitted})}
    limits = {}
    for x, m in models.items():
        own = [t for t, lang in held_back if lang == x and any(c.isalpha() for c in t or "")]
        assert len(own) >= 5
        plain, mixed = (median([m.entropy(f(t)) for t in own]) for f in (str, shuffled))
        limits[x] = (plain, strictness * max(0.0, mixed - plain))
    kept = []
    for r in rows:
        text = r["text"]
        if text is None or not any(c.isalpha() for c in text):
            continue
        h = {x: m.entropy(text) for x, m in models.items()}
        best = min(sorted(h), key=h.get)
        mean, width = limits[best]
        if h[best] <= mean + width * math.sqrt(1 + 20 / len(PlainKneserNey.units(text))):
            kept.append(r)
    return kept


def quality(model, features, rows, threshold=0.3):
    """The rows that a factorisation machine predicts good, all pairs of features written out."""
    kept = []
    for r in rows:
        index, value = features.one(r["text"])
        y = model.bias + sum(model.linear[i] * x for i, x in zip(index, value, strict=True))
        v = model.factors[index] * value[:, None]
        gram = v @ v.T
        y += (gram.sum() - np.trace(gram)) / 2
        if 1 / (1 + math.exp(-max(-30, min(30, y)))) >= threshold:
            kept.append(r)
    return kept


def near_duplicates(rows, width=5, percent=80):
    """One row of each component over all pairs of shingle sets; equal rows count once."""
    rows = [r for i, r in enumerate(rows) if all((r["doc_id"], r["text"]) != (q["doc_id"], q["text"]) for q in rows[:i])]
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                of[y] = x
    return [r for i, r in enumerate(rows) if find(i) == i]


def packed_well(pieces, rows, encode, closing=0, window=1024):
    """Every id of every row in one piece, in order; sequences without holes, of at most ``window`` ids, all full but one."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert set(by_doc) == {r["doc_id"] for r in rows}
    for r in rows:
        ids, at = np.array([*encode(r["text"] or ""), closing], "<u4"), 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    fill = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(fill.values(), default=0) <= window and sum(x < window for x in fill.values()) <= 1
