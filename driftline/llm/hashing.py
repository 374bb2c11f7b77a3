"""Hashed features of words, made for many words at once with numpy, and what the linear models share.

A word stands as its UTF-8 bytes between two marks. Its features are the buckets of the whole word and of all
its byte n-grams, whatever its length. Tokens of a batch become numbers first, so that each distinct word is
hashed once and a document is scored by gathers over its words.
"""

from __future__ import annotations

import numpy as np

BITS = 18
DIMS = 1 << BITS
GRAMS = (4, 5)
#: Words, and characters of words, that a worker keeps; the table is emptied between batches when it is fuller.
KEPT_WORDS, KEPT_CHARS = 300_000, 16_000_000
#: Odd multipliers of the hashes.
STEP, MIX, PAIR = 0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_STEP, _MIX, _PAIR, _SHIFT = np.uint64(STEP), np.uint64(MIX), np.uint64(PAIR), np.uint64(64 - BITS)


class Spelled:
    """Words as one array of bytes: ^word$ after ^word$."""

    def __init__(self, words: list[str]):
        raw = [b"^%b$" % w.encode("utf-8", "replace") for w in words]
        self.n = len(raw)
        self.size = np.fromiter(map(len, raw), np.int64, self.n)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        self.owner = np.repeat(np.arange(self.n), self.size)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hash, word number) of every n-gram of bytes, marks included."""
        count = max(0, len(self.data) - n + 1)
        h = np.full(count, np.uint64(n))
        for j in range(n):
            h = h * _STEP + self.data[j : j + count]
        inside = np.arange(count) + n <= (self.start + self.size)[self.owner[:count]]
        return h[inside] * _MIX, self.owner[:count][inside]

    def whole(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not self.n:
            return np.zeros(0, np.uint64)
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(self.size.max()) - 1, _STEP)), dtype=np.uint64)
        at = np.arange(len(self.data)) - self.start[self.owner]
        h = np.add.reduceat((self.data + np.uint64(1)) * powers[at], self.start) * _MIX
        return (h ^ (h >> np.uint64(29))) * _MIX


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _SHIFT).astype(np.int64)


def word_features(words: list[str], grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, word number of each, hash of each word)."""
    s = Spelled(words)
    whole = s.whole()
    parts = [(bucket(whole), np.arange(s.n))] + [(bucket(h), owner) for h, owner in map(s.grams, grams)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([o for _, o in parts]), whole


#: Bucket of a word that follows itself: repetition looks alike whatever the word.
SAME = 12_345


def pair_buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words from their hashes."""
    return np.where(h[:-1] == h[1:], SAME, bucket((h[:-1] * _PAIR + h[1:]) * _MIX))


class Words(dict):
    """word -> number. `settle` describes the words that came since, all at once, into the columns of `values`."""

    def __init__(self, describe):
        super().__init__()
        self.describe, self.fresh, self.values, self.chars = describe, [], None, 0

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def trim(self) -> None:
        if len(self) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.clear()
            self.values, self.chars = None, 0

    def settle(self) -> None:
        if self.fresh:
            new = self.describe(self.fresh)
            known = len(self) - len(self.fresh)
            if self.values is None:
                self.values = [np.zeros((1024, *c.shape[1:]), c.dtype) for c in new]
            for k, c in enumerate(new):
                if len(self.values[k]) < len(self):
                    grown = np.zeros((2 * len(self), *c.shape[1:]), c.dtype)
                    grown[:known] = self.values[k][:known]
                    self.values[k] = grown
                self.values[k][known : len(self)] = c
            self.chars += sum(map(len, self.fresh))
            self.fresh = []


class Tokens:
    """The words of a batch's documents as numbers: ids in one array, doc of each, first and count by document."""

    def __init__(self, documents: list[list[str]], words: Words | None = None):
        self.words = Words(None) if words is None else words
        self.count = np.fromiter(map(len, documents), np.int64, len(documents))
        self.first = np.cumsum(self.count) - self.count
        number = self.words.__getitem__
        self.ids = np.fromiter((i for d in documents for i in map(number, d)), np.int64, int(self.count.sum()))
        self.doc = np.repeat(np.arange(len(documents)), self.count)
        self.n = len(documents)
        if words is not None:
            words.settle()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum by document of one value a token."""
        return np.bincount(self.doc, values, self.n)

    def pairs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) of each two neighbours. h: hash by word number."""
        if len(self.ids) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self.doc[1:] == self.doc[:-1]
        return self.doc[1:][own], pair_buckets(h[self.ids])[own]


def sparse(documents: list[list[str]], pairs: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) by document: a word's features weigh its count / words, pairs likewise."""
    t = Tokens(documents)
    b, owner, whole = word_features(t.words.fresh)
    order = np.argsort(owner, kind="stable")
    b, size = b[order], np.bincount(owner, minlength=len(whole))
    start = np.cumsum(size) - size
    used, times = np.unique(t.doc * max(1, len(whole)) + t.ids, return_counts=True)
    doc, word = np.divmod(used, max(1, len(whole)))
    many = size[word]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[word], many)
    key, value = np.repeat(doc, many) * DIMS + b[at], np.repeat(times, many).astype(np.float64)
    if pairs:
        d, p = t.pairs(whole)
        key, value = np.append(key, d * DIMS + p), np.append(value, np.ones(len(p)))
    key, where = np.unique(key, return_inverse=True)
    value = np.bincount(where, value, len(key))
    doc = key // DIMS
    value = (value / t.count[doc]).astype(np.float32)
    edge = np.searchsorted(doc, np.arange(t.n + 1))
    buckets = (key % DIMS).astype(np.int32)
    return [(buckets[a:e], value[a:e]) for a, e in zip(edge[:-1], edge[1:], strict=True)]


class Rows:
    """Sparse rows in one place, for training; sums run over parts of them, so that little is held besides."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, start: np.ndarray):
        self.buckets, self.values, self.start = buckets, values, start
        self.n = len(start) - 1

    @classmethod
    def of(cls, buckets, values) -> Rows:
        """From Arrow lists, without a copy per row."""
        start = np.asarray(buckets.offsets).astype(np.int64)
        return cls(np.asarray(buckets.flatten()), np.asarray(values.flatten()), start - start[0])

    def take(self, at: np.ndarray) -> Rows:
        """Some of the rows."""
        size = (self.start[1:] - self.start[:-1])[at]
        start = np.append(0, np.cumsum(size))
        where = np.arange(start[-1]) + np.repeat(self.start[at] - start[:-1], size)
        return Rows(self.buckets[where], self.values[where], start)

    def parts(self, rows: int = 128):
        """(first row, rows) in parts, so that little is held besides."""
        return ((a, self.take(np.arange(a, min(a + rows, self.n)))) for a in range(0, self.n, rows))

    def dot(self, w: np.ndarray) -> np.ndarray:
        if self.n > 128:
            return np.concatenate([part.dot(w) for _, part in self.parts()])
        return np.bincount(np.repeat(np.arange(self.n), np.diff(self.start)), self.values * w[self.buckets], self.n)

    def back(self, g: np.ndarray, dims: int = DIMS) -> np.ndarray:
        """Sum of the rows, each times its g."""
        return np.bincount(self.buckets, self.values * np.repeat(g, np.diff(self.start)), dims)


class Adam:
    def __init__(self, shapes: list, rate: float):
        self.m, self.v, self.rate, self.t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], rate, 0

    def step(self, params: list, grads: list) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * score + b) is a probability; smoothed targets, Newton steps.
    With one class only, the slope stays positive and the smoothed rate sets the offset."""
    pos, neg = float((label == 1).sum()), float((label == 0).sum())
    t = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mid, scale = float(np.mean(score)), float(np.std(score)) or 1.0
    z = (score - mid) / scale
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(60):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    a = max(a, 1e-3)
    return a / scale, b - a * mid / scale
