"""Document quality by gated-attention multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (means of fixed word
descriptors plus the share of distinct words); gated attention weights, learnt from document labels
alone, average the passages' hidden vectors, and a logistic unit scores the average. Training
gathers the passage vectors, all of each document's, of at most `labelled` labelled documents with at most
`passages` passages together (documented bounds; documents are taken in the order of a hash) to the driver; two
thirds train, one third calibrates. Scoring reads every passage of every text.

Defined cases: a null or empty text is one passage without words; null ids are never held out and never
train; repeated rows score alike; without labels of both classes all scores equal the smoothed label rate;
words of any length are read whole; an empty table gives an empty result; other columns pass through unread, and
one named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import Written, labelled_sample, slices, tidied, tidy

PASSAGE, HASHED, HIDDEN, GATE = 64, 12, 16, 8
#: Characters whose shares describe a word.
MARKS = "#*$%&|<>!?.,;:-_/\\@+=~^\"'()[]{}"
WIDTH = 10 + HASHED


def kinds_of(chars: np.ndarray) -> np.ndarray:
    """0 and 1 for each character: capital, small letter, digit, mark, strong mark, !, ending."""
    own, at = np.unique(chars, return_inverse=True)
    rows = [(c.isupper(), c.islower(), c.isdigit(), c in MARKS, c in "#*$%&<>", c == "!", c in ".,;:?") for c in map(chr, own.tolist())]
    return np.array(rows, np.float64).reshape(-1, 7)[at]


def describe(words: list[str]) -> list[np.ndarray]:
    """Fixed vectors of words, all characters read: length, shares of kinds of characters, signed hashes of 3-grams."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    first = np.cumsum(n) - n
    kinds = kinds_of(chars)
    sums = np.add.reduceat(kinds, first, axis=0)
    out = np.zeros((len(words), WIDTH), np.float32)
    out[:, 0] = np.minimum(n, 40) / 10
    for k, kind in ((1, 0), (2, 2), (3, 3), (4, 4)):
        out[:, k] = sums[:, kind] / n
    out[:, 5] = [w in ("|", "-", "*", "•") for w in words]
    out[:, 6] = sums[:, 5] > 0
    out[:, 7] = kinds[first + n - 1, 6]
    out[:, 8] = n > 20
    out[:, 9] = (n > 1) & (sums[:, 0] > 0) & (sums[:, 1] == 0)
    spelled = H.Spelled(words)
    h, owner = spelled.grams(3)
    slot = ((h >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    out[:, 10:] = np.bincount(owner * HASHED + slot, sign, len(words) * HASHED).reshape(-1, HASHED) / spelled.size[:, None]
    return [out]


class Encoder:
    def __init__(self):
        self.words = H.Words(describe)

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(one row a passage, first row of each text): mean word vector, share of distinct words, share of words
        equal to the one before, fill."""
        self.words.trim()
        t = H.Tokens([(x or "").split() for x in texts], self.words)
        many = np.maximum(1, -(-t.count // PASSAGE))
        first = np.cumsum(many) - many
        out = np.zeros((int(many.sum()), WIDTH + 3), np.float32)
        if not len(t.ids):
            return out, first
        place = np.arange(len(t.ids)) - t.first[t.doc]
        part = first[t.doc] + place // PASSAGE
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        full = part[start]
        size = np.diff(np.append(start, len(part))).astype(np.float32)
        out[full, :WIDTH] = np.add.reduceat(self.words.values[0][t.ids], start, axis=0) / size[:, None]
        distinct = np.unique(part * np.int64(len(self.words)) + t.ids) // len(self.words)
        out[full, WIDTH] = np.bincount(distinct, minlength=len(out))[full] / size
        again = (t.ids[1:] == t.ids[:-1]) & (t.doc[1:] == t.doc[:-1])
        out[full, WIDTH + 1] = np.bincount(part[1:][again], minlength=len(out))[full] / size
        out[full, WIDTH + 2] = size / PASSAGE
        return out, first


def _forward(p: dict, x: np.ndarray, start: np.ndarray):
    """Scores of bags; x: passages of all bags, start: each bag's first."""
    h = np.tanh(x @ p["W"] + p["bw"])
    t, u = np.tanh(h @ p["V"]), H.sigmoid(h @ p["U"])
    e = (t * u) @ p["w"]
    bag = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
    top = np.maximum.reduceat(e, start)
    a = np.exp(e - top[bag])
    a /= np.add.reduceat(a, start)[bag]
    z = np.add.reduceat(h * a[:, None], start, axis=0)
    return z @ p["c"] + p["b"][0], (h, t, u, a, z, bag)


def train(x: np.ndarray, start: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.02, seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    p = {"W": r.normal(0, 0.3, (x.shape[1], HIDDEN)), "bw": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    names = list(p)
    adam = H.Adam([p[k].shape for k in names], rate)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(epochs):
        s, (h, t, u, a, z, bag) = _forward(p, x, start)
        g = (H.sigmoid(s) - y) * weight
        gz = g[:, None] * p["c"]
        ga = (gz[bag] * h).sum(1)
        ge = a * (ga - np.add.reduceat(a * ga, start)[bag])
        gt, gu = ge[:, None] * u * p["w"] * (1 - t * t), ge[:, None] * t * p["w"] * u * (1 - u)
        gh = gz[bag] * a[:, None] + gt @ p["V"].T + gu @ p["U"].T
        pre = gh * (1 - h * h)
        grads = {"W": x.T @ pre, "bw": pre.sum(0), "V": h.T @ gt, "U": h.T @ gu, "w": (t * u).T @ ge, "c": z.T @ g, "b": np.array([g.sum()])}
        adam.step([p[k] for k in names], [grads[k] + 1e-5 * p[k] for k in names])
    return p


def gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages, first of each document, labels) of (text, label, k) rows in the order of k."""

    def run(batches):
        encoder = Encoder()
        for batch in slices(batches):
            x, first = encoder.bags(batch.column(0).to_pylist())
            edge = np.append(first, len(x)).astype(np.int32) * (WIDTH + 3)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(edge), pa.array(x.ravel())), batch.column(2)], names=["label", "x", "k"])

    got = rows.select("text", "label", "k").mapInArrow(tidy(run), "label int, x array<float>, k long").toArrow()
    got = got.sort_by([("k", "ascending"), ("label", "ascending")])
    x = got["x"].combine_chunks()
    edge = np.asarray(x.offsets).astype(np.int64)
    return np.asarray(x.flatten()).reshape(-1, WIDTH + 3), (edge[:-1] - edge[0]) // (WIDTH + 3), got["label"].to_numpy().astype(np.int64)


def _held():
    """Sampled rows that calibrate."""
    return F.pmod(F.shiftright("k", 7), F.lit(3)) == 0


def fit(docs: DataFrame, labels: DataFrame, usable=None, labelled: int = 5000, passages: int = 200_000) -> dict:
    some = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, labelled)
    size = F.ceil((F.regexp_count("text", F.lit(r"\s+")) + 1) / PASSAGE)
    sample = Written(some.select("text", "label", F.xxhash64("doc_id", "text").alias("k"), size.alias("size")), "quality-sample")
    sizes = sample.df.select("k", "label", "size", _held().alias("held")).orderBy("k", "label").toArrow().to_pydict()  # at most `labelled` rows
    last = int(np.searchsorted(np.cumsum(sizes["size"]), passages, "right"))
    y = sizes["label"][:last]
    rate = float((sum(y) + 1) / (len(y) + 2))
    if len(set(y)) < 2:
        sample.drop()
        return {"p": None, "rate": rate}
    taken = sample.df.where(F.col("k") <= sizes["k"][last - 1])
    split = len(set(zip(y, sizes["held"], strict=False))) == 4
    x, start, y = gathered(taken.where(~_held()) if split else taken)
    mean, std = x.mean(0), x.std(0) + 1e-3
    p = train(((x - mean) / std).astype(np.float64), start, y)
    if split:
        x, start, y = gathered(taken.where(_held()))
    sample.drop()
    a, c = H.platt(_forward(p, (x - mean) / std, start)[0], y)
    del x
    tidied()
    return {"p": p, "mean": mean, "std": std, "a": a, "c": c, "rate": rate}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score in [0, 1] appended; a column of that name is replaced."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some KB, fixed
    at = docs.columns.index(text_col)

    def run(batches):
        m, encoder = shared.value, Encoder()
        for batch in slices(batches):
            if m["p"] is None or not batch.num_rows:
                out = np.full(batch.num_rows, m["rate"])
            else:
                x, start = encoder.bags(batch.column(at).to_pylist())
                out = H.sigmoid(m["a"] * _forward(m["p"], (x - m["mean"]) / m["std"], start)[0] + m["c"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], schema=batch.schema.append(pa.field(score_col, pa.float64())))

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
