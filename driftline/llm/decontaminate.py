"""Benchmark decontamination with an FM-index per training shard.

A shard is a part of an Arrow batch of documents. Its words become symbols of the benchmark's vocabulary; stretches
that cannot hold any window (a word outside the vocabulary, or two neighbours that are never neighbours in
a window) are cut out beforehand, which loses no occurrence. The rest is indexed, all windows are searched
backwards, their occurrences located, and the covered words merged into removal spans.

Benchmarks are read in blocks of at most BLOCK_BYTES of text, one at a time: a block is broadcast, searched for, and let
go. Of several blocks, each pass writes what it hits by text, and documents then meet what was found in theirs.

Defined cases: null and wordless texts have no words and no hits; items without words or with a null id have
no windows; an item under 13 words is one window; equal windows of several items count for each; repeated item ids
count once; repeated documents and null ids each give their own row; an empty benchmark hits nothing; an empty
table gives an empty result; other columns are ignored by `report` and kept by `cleaned`.
"""

from __future__ import annotations

import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sieve, Written, slices, tidy
from .fmindex import FMIndex

WINDOW, BLOCK_BYTES, SHARD_SYMBOLS, SHARD_ROWS = 13, 8 << 20, 2_000_000, 2048
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes: letters to lower case, what no word holds to a space. All bytes over 0x7F belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Windows:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.patterns = sorted(found)
        self.items = [sorted(found[p]) for p in self.patterns]
        self.length = np.array([len(p) for p in self.patterns], np.int64)
        self.aligned = np.zeros((len(self.patterns), WINDOW), np.int64)
        for k, p in enumerate(self.patterns):
            self.aligned[k, WINDOW - len(p) :] = p
        self.least = int(self.length.min(initial=WINDOW))
        self.size = len(self.vocabulary) + 1
        pairs = {a * self.size + b for p in self.patterns for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)

    def neighbours(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return self.pairs[at] == key

    def stretches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the stretches of a document that may hold windows."""
        n = len(ids)
        joint = (ids[:-1] > 0) & (ids[1:] > 0)
        joint[joint] = self.neighbours(ids[:-1][joint] * self.size + ids[1:][joint])
        cut = np.flatnonzero(~joint) + 1
        first, end = np.append(0, cut), np.append(cut, n)
        keep = (end - first >= self.least) & (ids[first] > 0)
        return first[keep], end[keep]


class Shard:
    """Documents of one shard: text of kept stretches, where they come from."""

    def __init__(self, windows: Windows):
        self.windows, self.parts, self.doc, self.word = windows, [], [], []
        self.size = 0

    def add(self, doc: int, words: list[bytes]) -> None:
        if not words or not self.windows.patterns:
            return
        ids = np.fromiter((self.windows.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        for a, b in zip(*(x.tolist() for x in self.windows.stretches(ids)), strict=True) if len(ids) else ():
            self.parts.append(np.append(ids[a:b], 0))
            self.doc.append(np.full(b - a + 1, doc))
            self.word.append(np.arange(a, b + 1))
            self.size += b - a + 1

    def hits(self) -> dict[int, tuple[np.ndarray, set[str]]]:
        """doc -> (hit word numbers, items)."""
        if not self.parts:
            return {}
        text, doc, word = np.concatenate(self.parts), np.concatenate(self.doc), np.concatenate(self.word)
        index = FMIndex(text, self.windows.size)
        low, high = index.search(self.windows.aligned, self.windows.length)
        times = high - low
        which = np.repeat(np.arange(len(low)), times)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
        at = index.locate(rows)
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.windows.length[which], -1)
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        out: dict[int, tuple[np.ndarray, set[str]]] = {}
        if not len(hit):
            return {}
        owners = doc[hit]
        docs, first = np.unique(owners, return_index=True)
        for d, a, b in zip(docs.tolist(), first.tolist(), np.append(first[1:], len(hit)).tolist(), strict=True):
            out[d] = (word[hit[a:b]], set())
        for d, k in np.unique(np.stack([doc[at], which]), axis=1).T.tolist() if len(at) else ():
            out[d][1].update(self.windows.items[k])
        return out


def spans_of(words: np.ndarray) -> list[int]:
    """Sorted word numbers as first, end, first, end, ..."""
    if not len(words):
        return []
    cut = np.flatnonzero(np.diff(words) > 1) + 1
    first, last = words[np.append(0, cut)], words[np.append(cut, len(words)) - 1]
    return np.stack([first, last + 1], 1).ravel().tolist()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Blocks of (item, text) of bounded size, streamed to the driver one at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    block, size = [], 0
    for item, text in rows.distinct().toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield sorted(block)
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield sorted(block)


FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]


def _joined(lists: list[list[int]]) -> list[int]:
    """Union of span lists."""
    words = [np.arange(a, b) for s in lists for a, b in zip(s[::2], s[1::2], strict=True)]
    return spans_of(np.unique(np.concatenate(words))) if words else []


def _searched(texts: list[str | None], windows: Windows) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """(words, spans of hit words, items) of each text."""
    counts, hits, shard = [], {}, Shard(windows)
    for d, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        shard.add(d, words)
        if shard.size > SHARD_SYMBOLS:
            hits |= shard.hits()
            shard = Shard(windows)
    hits |= shard.hits()
    return counts, [spans_of(hits[d][0]) if d in hits else [] for d in range(len(counts))], [sorted(hits[d][1]) if d in hits else [] for d in range(len(counts))]


class Output:
    """What becomes of a batch: the columns of `docs`, without the text and with what was found; or, with edit,
    without contaminated rows and hit words."""

    def __init__(self, docs: DataFrame, text_col: str, edit: bool):
        self.text_col, self.edit = text_col, edit
        self.kept = [f for f in docs.schema.fields if edit or f.name != text_col]
        self.found = [] if edit else [T.StructField(f"__found_{f.name}", f.dataType) for f in FOUND]
        self.schema = T.StructType([*self.kept, *self.found])

    def batch(self, batch: pa.RecordBatch, texts: list, counts: list, spans: list, items: list) -> pa.RecordBatch:
        columns = [batch.column(f.name) for f in self.kept]
        if not self.edit:
            columns += [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=self.schema.names)
        hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        stay = [20 * h < n or not h for h, n in zip(hit, counts, strict=True)]
        k = self.schema.names.index(self.text_col)
        if any(h and ok for h, ok in zip(hit, stay, strict=True)):
            columns[k] = pa.array([cut_words(t, s) if s and ok else t for t, s, ok in zip(texts, spans, stay, strict=True)], columns[k].type)
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names).filter(pa.array(stay, pa.bool_()))


def _one_pass(docs: DataFrame, items: list[tuple[str, str]], text_col: str, edit: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES and one item
    out = Output(docs, text_col, edit)

    def run(batches):
        windows = Windows(shared.value)
        for batch in slices(batches, SHARD_ROWS):
            texts = batch.column(text_col).to_pylist()
            yield out.batch(batch, texts, *_searched(texts, windows))

    return docs.mapInArrow(tidy(run), out.schema)


def _text_key(text_col: str) -> list:
    return [F.xxhash64(text_col).alias("__t"), F.hash(text_col).alias("__u")]


def _block_hits(docs: DataFrame, items: list[tuple[str, str]], text_col: str) -> Written:
    """(text's key, spans, items) of the texts that one block hits."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        windows = Windows(shared.value)
        for batch in slices(batches, SHARD_ROWS):
            _, spans, names = _searched(batch.column(2).to_pylist(), windows)
            hit = pa.array([bool(s) for s in spans], pa.bool_())
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["__t", "__u", "spans", "items"])
            yield rows.filter(hit)

    rows = docs.select(*_text_key(text_col), text_col).mapInArrow(tidy(run), "__t long, __u int, spans array<int>, items array<string>")
    found = Written(rows.groupBy("__t", "__u").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "block-hits")
    shared.destroy()
    return found


def found(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", edit: bool = False) -> DataFrame:
    """`docs` without texts and with __found_n_words, __found_spans, __found_items; or, with edit, cleaned."""
    blocks = _blocks(benchmark, item_col, "text")
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _one_pass(docs, first, text_col, edit)
    hits = [_block_hits(docs, items, text_col) for items in chain([first, second], blocks)]
    every = hits[0].df
    for h in hits[1:]:
        every = every.union(h.df)
    merged = Written(every.groupBy("__t", "__u").agg(F.collect_list("spans").alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items")), "hits")
    for h in hits:
        h.drop()
    own = docs.columns
    marked = Sieve(merged.df, "__t").marked(docs.select("*", *_text_key(text_col)), "__t", "__some")
    joined = marked.where("__some").join(merged.df, ["__t", "__u"], "left").select(*own, "__spans", "__items")
    kinds = dict(joined.dtypes)
    rest = marked.where("not __some").select(*own, F.lit(None).cast(kinds["__spans"]).alias("__spans"), F.lit(None).cast(kinds["__items"]).alias("__items"))
    out = Output(docs, text_col, edit)

    def run(batches):
        for batch in slices(batches, SHARD_ROWS):
            texts = batch.column(text_col).to_pylist()
            spans = [_joined(s) if s else [] for s in batch.column("__spans").to_pylist()]
            yield out.batch(batch, texts, [len(words_of(t)) for t in texts], spans, [x or [] for x in batch.column("__items").to_pylist()])

    return joined.union(rest).mapInArrow(tidy(run), out.schema)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) per row; spans are hit words, first and end in turn."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = found(slim, benchmark).toDF("id", "n_words", "spans", "items")
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("n_hit", hit)
    return rows.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans",
    )


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def cut_words(text: str, spans: list[int]) -> str:
    """The text without its hit words (and what stands between them)."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without contaminated rows; other rows lose their hit words, rows without hits stay as they are."""
    return found(docs, benchmark, text_col, edit=True)
