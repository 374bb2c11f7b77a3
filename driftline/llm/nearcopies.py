"""Near copies by the exact Jaccard similarity of shingle sets.

A document's shingle set gives BANDS keys, each made of DEPTH minimum hashes; two sets of similarity s share
a key with probability 1 - (1 - s ** DEPTH) ** BANDS, whatever their sizes: all but 7 in a million at 0.8.
Documents that share a key meet in a bucket, where SimHash prints of the sets are compared in tiles by exclusive-or
and bit counts; pairs within RADIUS bits that nothing links yet are confirmed by their whole sets. (Prints alone,
dealt by blocks of bits, can't find pairs at 0.8: they differ in 15 % of the bits.) A bucket gives a star per group it
connects, never all its pairs; buckets of equal members are compared once.

No bucket is capped or dropped, and none is one task's work: one with more than CHUNK members (or CHUNK_SHINGLES
shingles) is first dealt in chunks. Members that the chunks of all buckets don't tie together then meet in
cells: those outside the bucket's largest tied group meet all others, a chunk of them and a chunk of all at a time.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sieve, Written, sized, slices, tidy
from .graph import components

SEED, BANDS, DEPTH = 42, 30, 5
TILE, RADIUS, WORDS = 256, 64, 3
CHUNK, CHUNK_SHINGLES = 1024, 4_000_000
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_RANDOM = np.random.default_rng(SEED)
_MUL = _RANDOM.integers(0, 1 << 63, (3, BANDS * DEPTH), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text shorter than a shingle is one, an empty one has none."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.append(0, end[:-1] + 1)
    last = end[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=False)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set: a hash of DEPTH minimum hashes each."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):  # bounded memory for very long texts
        np.minimum(least, (hashes[at : at + 512, None] * _MUL[0] + _MUL[1]).min(0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * _MUL[2]
    return (mixed ^ (mixed >> np.uint64(32))).reshape(BANDS, DEPTH).sum(1, dtype=np.uint64)


def print_of(hashes: np.ndarray) -> np.ndarray:
    """SimHash print of a set: WORDS words of 64 bits."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096, None] ^ (hashes[at : at + 4096, None] >> np.uint64(31))) * _MUL[1, :WORDS]
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(np.ascontiguousarray(mixed).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(k, doc_id, text) -> (k, doc_id, node, size, keys): node names the shingle set."""
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = [band_keys(s).view(np.int64) for s in sets]
            ends = np.cumsum([0] + [len(x) for x in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), lists], names=[*(f.name for f in fields), "node", "size", "keys"])

    more = [T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, *more]))


def linked(sets: list[np.ndarray], similarity: float, known: list | None = None) -> np.ndarray:
    """Label of each set (a member's number) after comparing all pairs that no chain of pairs has linked yet.
    known: names of groups that are linked already (None: none)."""
    n = len(sets)
    lab, first = np.arange(n), {}
    for i, name in enumerate(known or ()):
        if name is not None:
            lab[i] = first.setdefault(name, i)
    if not (lab != lab[0]).any():
        return lab
    size = np.array([len(s) for s in sets])
    prints = np.stack([print_of(s) for s in sets])
    bits = np.bitwise_count(prints).sum(1, dtype=np.int64)
    order = np.argsort(bits, kind="stable")
    size, prints, bits = size[order], prints[order], bits[order]
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            if bits[b] - bits[min(a + TILE, n) - 1] > RADIUS:
                break  # later tiles have more bits still
            apart = sum(np.bitwise_count(prints[a : a + TILE, None, k] ^ prints[None, b : b + TILE, k]).astype(np.int16) for k in range(WORDS))
            small, large = np.minimum(size[a : a + TILE, None], size[None, b : b + TILE]), np.maximum(size[a : a + TILE, None], size[None, b : b + TILE])
            near = (apart <= RADIUS) & (small >= similarity * large)
            for i in np.flatnonzero(near.any(1)).tolist():
                me = order[a + i]
                others = order[b + np.flatnonzero(near[i])]
                others = others[lab[others] != lab[me]]
                alike = [j for j in others.tolist() if same(sets[me], sets[j], similarity)]
                if alike:
                    tied = np.unique(lab[np.append(alike, me)])
                    lab[np.isin(lab, tied)] = tied[0]
    return lab


def same(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return both / (len(a) + len(b) - both) >= similarity


def _stars(cells: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(cell, node, known, text) -> (a, b) links between nodes that connect what each cell ties together."""

    def run(batches):
        cell, nodes, known, sets = None, [], [], []

        def star():
            lab = linked(sets, similarity, known)
            i = np.flatnonzero(lab != np.arange(len(lab)))
            named = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(named[i]), pa.array(named[lab[i]])], names=["a", "b"])

        for batch in slices(batches, 64):
            for c, node, name, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != cell:
                    if nodes:
                        yield star()
                    cell, nodes, known, sets = c, [], [], []
                nodes.append(node)
                known.append(name)
                sets.append(shingle_set(text, shingle))
        if nodes:
            yield star()

    rows = cells.select("cell", "node", F.col("known").cast("long").alias("known"), "text")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(run), "a long, b long")


def _part(n, *by):
    """A chunk number below n, by a hash of the columns."""
    return F.pmod(F.xxhash64(*by), n).cast("int")


def links(printed: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) links between nodes that connect all that share a key and are of the similarity.
    printed: `signed` rows; docs: the (k, text) rows they came from."""
    sets = Written(printed.groupBy("node").agg(F.min("k").alias("k"), F.first("size").alias("size"), F.first("keys").alias("keys")), "sets")
    dealt = sets.df.select(F.explode("keys").alias("key"), "node", "size")
    # A bucket's name tells its members: buckets of equal members become one.
    buckets = dealt.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    keys = Written(buckets.where("n > 1").select("key", F.xxhash64("n", "x", "y").alias("bucket")), "keys")
    hit = Sieve(keys.df, "key").marked(dealt, "key", "hit").where("hit").drop("hit")
    met = Written(hit.join(sized(keys.df, 16), "key").select("bucket", "node", "size").distinct(), "met")
    held = Written(sets.df.select("node", "k").join(sized(met.df.select("node").distinct(), 8), "node", "left_semi"), "held")
    near = Sieve(held.df, "k").marked(docs.select("k", "text"), "k", "near").where("near").drop("near")
    texts = Written(near.join(sized(held.df, 16), "k").groupBy("node").agg(F.min("text").alias("text")), "texts")
    many = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES))
    large = Written(met.df.groupBy("bucket").agg(many.cast("long").alias("parts")).where("parts > 1"), "large")
    whole = met.df.join(sized(large.df, 16), "bucket", "left").select("bucket", "node", F.coalesce("parts", F.lit(1)).alias("parts"))
    chunks = whole.select(F.xxhash64("bucket", _part(F.col("parts"), "bucket", "node")).alias("cell"), "node", F.lit(None).alias("known"))
    first = Written(_stars(chunks.join(texts.df, "node"), shingle, similarity), "links")
    for t in (sets, keys, held):
        t.drop()
    if not large.df.take(1):
        return first.df
    tied = components(first.df)
    members = whole.where("parts > 1").join(sized(tied.df.toDF("node", "root"), 16), "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = Written(members, "members")
    groups = members.df.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = groups.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    main = Written(main.select("bucket", "main", F.ceil(F.col("others") / CHUNK).cast("long").alias("rest")), "main")
    torn = members.df.join(sized(main.df, 24), "bucket")
    span = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    everyone = torn.select("bucket", "node", "root", _part(F.col("parts"), "bucket", "node").alias("i"), span(F.col("rest")).alias("j"))
    others = torn.where("root <> main").select("bucket", "node", "root", span(F.col("parts")).alias("i"), _part(F.col("rest"), "node", "bucket").alias("j"))
    cells = everyone.union(others).distinct().select(F.xxhash64("bucket", "i", "j").alias("cell"), "node", F.col("root").alias("known"))
    return first.df.union(_stars(cells.join(texts.df, "node"), shingle, similarity))
