"""Toxicity by non-negative positive-unlabelled learning over hashed words and their byte n-grams.

The classifier sees confirmed toxic documents and, as unlabelled text, every document that may be learnt from. Its
risk is that of the positives plus that of the unlabelled as negatives, less the class prior's share of the
positives' among them; this difference is kept non-negative. With the squared loss all three risks depend on the
rows only through their second moments over SELECTED features, so one pass over the corpus gathers one sum per
pair of features, whatever its size, and the driver holds a table of fixed size. A feature's value is its number
of words, MOST at most, over the root of the document's, in whole steps of 1 / UNIT, so that sums are exact.

Features are selected by how their document rates differ between confirmed toxic and other labelled rows.
Scores are calibrated on labelled rows by models that have not seen the row's third of the positives.

Bounds (documented parameters): at most `positives` confirmed documents, and `labelled` rows for prior, selection
and calibration, are gathered. Unlabelled documents are not sampled.

Defined cases: a null or empty text has no words and scores what the model's bias says; null ids are never
held out and never train; repeated rows score alike; an empty table gives an empty result, and without
any confirmed toxic row nothing is called toxic and all scores are 0; words of any length count whole; other
columns pass through unread, and one named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import Written, labelled_sample, slices, tidied, tidy

SELECTED, FOLDS, LEAST_Z = 512, 3, 3.0
MOST, UNIT, GAIN = 4, 64, 10.0


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def rates(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows (text, label) -> documents with each feature among the positives and the others, and their numbers."""

    def run(batches):
        seen, n = np.zeros((2, H.DIMS), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches):
            label = np.array(batch.column(1).to_pylist(), np.int64)
            for y, (b, _) in zip(label.tolist(), H.sparse([split_words(t) for t in batch.column(0).to_pylist()]), strict=True):
                seen[y][b] += 1
            n += np.bincount(label, minlength=2)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[1][at], n[1])), pa.array(np.append(seen[0][at], n[0]))], names=["b", "pos", "neg"])

    got = rows.select("text", "label").mapInArrow(tidy(run), "b long, pos long, neg long").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    b, pos, neg = (got[c].to_numpy() for c in ("b", "pos", "neg"))
    total = b < 0
    out = np.zeros((2, H.DIMS), np.int64)
    out[1][b[~total]], out[0][b[~total]] = pos[~total], neg[~total]
    return out[1], out[0], int(pos[total].sum()), int(neg[total].sum())


def chosen(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, scale) of the SELECTED features whose rates differ most beyond chance; the scale is the log ratio."""
    rate_pos, rate_neg, both = pos / n_pos, neg / max(1, n_neg), (pos + neg) / (n_pos + n_neg)
    z = (rate_pos - rate_neg) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_pos + 1 / max(1, n_neg)))
    ratio = np.log((rate_pos + 0.5 / n_pos) / (rate_neg + 0.5 / n_pos))
    weight = np.abs(ratio) * np.clip((np.abs(z) - LEAST_Z) / LEAST_Z, 0, 1)
    best = np.lexsort((np.arange(H.DIMS), -weight))[:SELECTED]
    best = np.sort(best[weight[best] > 0])
    return best, weight[best] * GAIN / UNIT


class Selected:
    """The selected features of documents."""

    def __init__(self, buckets: np.ndarray):
        self.place = np.full(H.DIMS, -1)
        self.place[buckets] = np.arange(len(buckets))
        self.k = max(1, len(buckets))
        self.words = H.Words(self._describe)
        self._clear()

    def _clear(self) -> None:
        self.features, self.taken = np.zeros(0, np.int64), 0

    def _describe(self, words: list[str]) -> list[np.ndarray]:
        b, owner, _ = H.word_features(words)
        p = self.place[b]
        keep = p >= 0
        key = np.unique(owner[keep] * self.k + p[keep])
        many = np.bincount(key // self.k, minlength=len(words))
        start = self.taken + np.cumsum(many) - many
        self.features, self.taken = np.append(self.features, key % self.k), self.taken + len(key)
        return [start, many]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document * k + feature, sorted and distinct; value)."""
        if len(self.words) > H.KEPT_WORDS or self.words.chars > H.KEPT_CHARS:
            self._clear()
        self.words.trim()
        t = H.Tokens([split_words(x) for x in texts], self.words)
        if not len(t.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        start, many = self.words.values
        some = many[t.ids] > 0
        ids, doc = t.ids[some], t.doc[some]
        m = many[ids]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[ids], m)
        key, count = np.unique(np.repeat(doc, m) * self.k + self.features[at], return_counts=True)
        return key, np.rint(np.minimum(count, MOST) * UNIT / np.sqrt(t.count[key // self.k]))


def moments(docs: DataFrame, buckets: np.ndarray) -> np.ndarray:
    """Over all rows of `docs` (text): sums of products of features i and j; the last one is 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(buckets)  # SELECTED numbers

    def run(batches):
        selected = Selected(shared.value)
        k = selected.k
        total = np.zeros((k + 1, k + 1))
        for batch in slices(batches):
            x = np.zeros((batch.num_rows, k + 1))
            x[:, k] = 1
            key, value = selected.of(batch.column(0).to_pylist())
            x[key // k, key % k] = value
            total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    got = docs.select("text").mapInArrow(tidy(run), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((max(1, len(buckets)) + 1,) * 2)
    i, j, n = (got[c].to_numpy() for c in ("i", "j", "n"))
    out[i, j] = n
    out[j, i] = n
    return out


def gathered(rows: DataFrame, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x features, 1 last; labels; folds) of a bounded sample (text, label, k)."""
    shared = rows.sparkSession.sparkContext.broadcast(buckets)

    def run(batches):
        selected = Selected(shared.value)
        for batch in slices(batches):
            key, value = selected.of(batch.column(0).to_pylist())
            edge = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * selected.k).astype(np.int32))
            at, value = (pa.ListArray.from_arrays(edge, pa.array(v.astype(np.int32))) for v in (key % selected.k, value))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), at, value], names=["label", "k", "at", "value"])

    got = rows.select("text", "label", "k").mapInArrow(tidy(run), "label int, k long, at array<int>, value array<int>").toArrow().sort_by([("k", "ascending"), ("label", "ascending")])
    x = np.zeros((got.num_rows, max(1, len(buckets)) + 1), np.float32)
    x[:, -1] = 1
    for i, (at, value) in enumerate(zip(got["at"].to_pylist(), got["value"].to_pylist(), strict=True)):
        x[i, at] = value
    return x, got["label"].to_numpy().astype(np.int64), (got["k"].to_numpy().view(np.uint64) >> np.uint64(9)) % np.uint64(FOLDS)


def train_nnpu(pos: np.ndarray, unlabelled: np.ndarray, prior: float, scale: np.ndarray, steps: int = 100, rate: float = 0.5, decay: float = 0.1) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative PU risk with the squared loss. pos: rows of positives;
    unlabelled: their `moments`. Steps are damped Newton steps of the plain risk; where the negatives' risk
    falls below zero, they walk it back, as far as zero by its slope."""
    s = np.append(scale, 1.0)
    mu = unlabelled / max(1.0, unlabelled[-1, -1]) * np.outer(s, s)
    xp = pos * s
    mp = xp.T @ xp / len(xp)
    ridge = np.append(np.full(len(scale), decay), 1e-9)
    solve = np.linalg.inv(0.5 * mu + np.diag(ridge))
    w = np.zeros(len(s))
    for _ in range(steps):
        gu, gp = mu @ w, mp @ w  # E[x s]; the last row of a moment is E[x]
        negative = 0.25 * (1 + 2 * (mu[-1] @ w) + w @ gu) - prior * 0.25 * (1 + 2 * (mp[-1] @ w) + w @ gp)
        g_neg = 0.5 * (mu[-1] + gu) - prior * 0.5 * (mp[-1] + gp)
        g_pos = prior * 0.5 * (gp - mp[-1])
        if negative >= 0:
            w -= rate * (solve @ (g_pos + g_neg + ridge * w))
        else:
            back = solve @ g_neg
            w += min(rate, -negative / max(1e-12, float(back @ g_neg))) * back
    return w * s


def fit(docs: DataFrame, labels: DataFrame, usable=None, positives: int = 6000, labelled: int = 6000) -> dict:
    usable = F.lit(True) if usable is None else usable
    some = labelled_sample(docs, labels.where("toxic = 1"), "toxic", usable, positives).withColumn("own", F.lit(False))
    some = some.unionByName(labelled_sample(docs, labels, "toxic", usable, labelled).withColumn("own", F.lit(True)))
    sample = Written(some.withColumn("k", F.xxhash64("doc_id", "text")), "toxicity-sample")
    general = sample.df.where("own")
    pos, neg, n_pos, n_neg = rates(general.unionByName(sample.df.where("not own")).dropDuplicates(["k", "label"]))
    nothing = {"buckets": np.zeros(0, np.int64), "w": np.zeros(0), "b": 0.0, "a": 0.0, "c": -35.0, "prior": 0.0}
    if not n_pos:
        sample.drop()
        return nothing
    buckets, scale = chosen(pos, neg, n_pos, n_neg)
    xp, _, fold_p = gathered(sample.df.where("not own"), buckets)
    xl, y, fold_l = gathered(general, buckets)
    sample.drop()
    prior = float((y.sum() + 1) / (len(y) + 2))
    unlabelled = moments(docs.where(F.col("doc_id").isNotNull() & usable), buckets)
    scale = scale if len(scale) else np.zeros(1)
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        learn = xp[fold_p != f] if (fold_p != f).any() else xp
        raw[fold_l == f] = xl[fold_l == f] @ train_nnpu(learn, unlabelled, prior, scale)
    w = train_nnpu(xp, unlabelled, prior, scale)
    a, c = H.platt(raw, y)
    del xp, xl, unlabelled, pos, neg
    tidied()
    return {"buckets": buckets, "w": w[:-1], "b": float(w[-1]), "a": a, "c": c, "prior": prior}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score in [0, 1] appended (a column of that name is replaced); whole texts, in Arrow batches."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some KB, fixed
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        selected, w = Selected(m["buckets"]), np.append(m["w"], 0.0)
        for batch in slices(batches):
            key, value = selected.of(batch.column(at).to_pylist())
            raw = m["b"] + np.bincount(key // selected.k, w[key % selected.k] * value, batch.num_rows)
            out = H.sigmoid(m["a"] * raw + m["c"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], schema=batch.schema.append(pa.field(score_col, pa.float64())))

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
