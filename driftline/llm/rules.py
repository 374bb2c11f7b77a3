"""Quality rules: exact counts with fixed limits, then a calibrated n-gram classifier.

The counts are those of the contract (words, symbols, repeated lines, repeated 3-word windows). A
document that passes the fixed limits is kept if a logistic regression over hashed words, word pairs
and character n-grams, trained on labelled quality rows and calibrated to a probability, scores at least
KEEP_AT. Training gathers at most `labelled` rows, as sparse features, to the driver.

Defined cases: null and empty texts have no words, fail the fixed limits and are not kept; null ids give
rows with a null id and never train; without labels of both classes the classifier keeps all;
repeated rows are judged alike; words of any length count whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import Written, labelled_sample, slices, tidied, tidy

#: Fixed limits.
MIN_WORDS, MAX_REPEATED_PERCENT, KEEP_AT = 50, 50, 0.5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_SPACE = " \t\n\x0b\x0c\r"
_DROP_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_ASCII_SPACE)]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice, first occurrences included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    base = np.int64(ids.max() + 1)
    if base < 2_000_000:
        key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        key = pair[:-1] * base + ids[2:]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def train(rows: H.Rows, y: np.ndarray, epochs: int = 12, rate: float = 0.2, decay: float = 1e-7, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression by steps over shuffled parts of the rows."""
    w, b = np.zeros(H.DIMS), np.zeros(1)
    adam, order = H.Adam([H.DIMS, 1], rate), np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs)
        for at in np.array_split(order.permutation(len(y)), max(1, len(y) // 128)):
            part = rows.take(at)
            g = (H.sigmoid(part.dot(w) + b[0]) - y[at]) * weight[at] / len(at)
            adam.step([w, b], [part.back(g) + decay * w, np.array([g.sum()])])
    return w, float(b[0])


def gathered(rows: DataFrame) -> tuple[H.Rows, np.ndarray, np.ndarray]:
    """Features of (text, label, k) rows, computed on the executors, in the order of k."""

    def run(batches):
        for batch in slices(batches):
            got = H.sparse([words_of(t) for t in batch.column(0).to_pylist()], pairs=True)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([b for b, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32())), batch.column(2)], names=["label", "b", "v", "k"])

    got = rows.select("text", "label", "k").mapInArrow(tidy(run), "label int, b array<int>, v array<float>, k long").toArrow()
    got = got.sort_by([("k", "ascending"), ("label", "ascending")])
    b, v = got["b"].combine_chunks(), got["v"].combine_chunks()
    return H.Rows.of(b, v), got["label"].to_numpy().astype(np.int64), got["k"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, usable=None, labelled: int = 4000) -> dict:
    """Two thirds of the sampled rows train, one third calibrates."""
    some = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, labelled).withColumn("k", F.xxhash64("doc_id", "text"))
    sample = Written(some, "rules-sample")
    count = {(r.held, r.label): r.n for r in sample.df.groupBy(_held().alias("held"), "label").agg(F.count("*").alias("n")).collect()}
    empty = {"w": np.zeros(H.DIMS, np.float32), "b": 0.0, "a": 0.0, "c": 20.0}
    if len({y for _, y in count}) < 2:
        sample.drop()
        return empty
    split = all(count.get((h, y)) for h in (True, False) for y in (0, 1))
    rows, y, _ = gathered(sample.df.where(~_held()) if split else sample.df)
    w, b = train(rows, y)
    if split:
        rows, y, _ = gathered(sample.df.where(_held()))
    a, c = H.platt(rows.dot(w) + b, y)
    sample.drop()
    del rows
    tidied()
    return {"w": w.astype(np.float32), "b": b, "a": a, "c": c}


def _held():
    """Sampled rows that calibrate."""
    return F.pmod(F.shiftright("k", 7), F.lit(3)) == 0


def judge(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, fixed

    def run(batches):
        m = shared.value
        w = m["w"].astype(np.float64)

        def describe(new: list[str]) -> list[np.ndarray]:
            b, owner, whole = H.word_features(new)
            return [np.bincount(owner, w[b], len(new)), whole, np.fromiter(map(len, new), np.int64, len(new))]

        words = H.Words(describe)
        for batch in slices(batches):
            words.trim()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            t = H.Tokens([words_of(x) for x in texts], words)
            value, whole, length = words.values or [np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
            doc, pair = t.pairs(whole)
            raw = (t.sums(value[t.ids]) + np.bincount(doc, w[pair], t.n)) / np.maximum(1, t.count)
            score = np.where(t.count > 0, H.sigmoid(m["a"] * (raw + m["b"]) + m["c"]), 0.0)
            repeated = np.fromiter((repeated_words(t.ids[a : a + n]) for a, n in zip(t.first, t.count, strict=True)), np.int64, t.n)
            failed = (t.count < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * t.count)
            symbols = [len(x) - len(x.translate(_DROP_SYMBOLS)) for x in texts]
            columns = (t.count, t.sums(length[t.ids]).astype(np.int64), symbols, list(map(duplicate_lines, texts)), repeated, failed, score, ~failed & (score >= KEEP_AT))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
