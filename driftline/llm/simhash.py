"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints of equal documents collapse first. Distinct fingerprints are dealt to buckets by some of their bits:
of radius + s blocks of bits two fingerprints within the radius agree on s at least, so there is one key per choice of
s blocks. A key has as many bits of its blocks as leave about TILE fingerprints to a bucket, and s is the least
number of blocks that has so many. Within a bucket, tiles sorted by bit count are compared by numpy exclusive-or
and bit counts, skipping tile pairs whose bit counts differ by more than the radius. A bucket gives a star
per group it connects, never all its pairs. No candidate is capped or dropped: a bucket of more than PART
fingerprints is split, and each two of its parts meet in a task of their own.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts shorter than
a shingle are one shingle; null ids keep their row, and a component without any id has a null
component_id; repeated rows share a component; an empty table gives an empty result; other columns are
ignored by `fingerprints` and `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

import string
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nearcopies
from .common import Written, sized, slices, tidy
from .graph import components

SEED, SHINGLE, RADIUS = 42, 3, 2
TILE, PART = 1024, 32 * 1024
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    first, last = np.append(0, end[:-1] + 1), end[min(shingle, len(words)) - 1 :]
    n, ones, digest = len(last), np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, 4096):  # bounded memory for very long texts
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + 4096].tolist(), last[at : at + 4096].tolist(), strict=False)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """`docs` without its text and with the fingerprint `fp` (signed 64 bits)."""
    at = docs.columns.index(text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fp)], names=[*(f.name for f in rest), "fp"])

    return docs.mapInArrow(tidy(run), T.StructType([*rest, T.StructField("fp", T.LongType())]))


def masks(radius: int, n: int, tile: int = TILE) -> list[int]:
    """One mask per choice of blocks, for n fingerprints; two within the radius agree under some of them."""
    wanted = max(0, -(-n // tile) - 1).bit_length()
    for shared in range(1, 7):
        blocks = radius + shared
        edges = [64 * i // blocks for i in range(blocks + 1)]
        if shared * (64 // blocks) >= wanted or shared == 6:
            break
    own = [min(e - a, -(-wanted // shared)) for a, e in zip(edges, edges[1:], strict=False)]
    parts = [((1 << bits) - 1) << a for a, bits in zip(edges, own, strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(parts, shared))]


def _merge(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Tie the groups of i and j: labels point at the least member seen."""
    while len(i):
        a, b = lab[i], lab[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(lab, high, low)
        while not np.array_equal(nxt := lab[lab], lab):
            lab[:] = nxt
        apart = lab[i] != lab[j]
        i, j = i[apart], j[apart]


def linked(group: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Label of each fingerprint after comparing all pairs of its group. Rows are sorted by group, then bit count."""
    n = len(fp)
    lab = np.arange(n)
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, int)
    bits = np.bitwise_count(fp).astype(np.int16)
    for at, end in zip(start.tolist(), [*start[1:].tolist(), n], strict=False):
        for a in range(at, end, TILE):
            ae = min(a + TILE, end)
            for b in range(a, end, TILE):
                if bits[b] - bits[ae - 1] > radius:
                    break  # later tiles have more bits still
                be = min(b + TILE, end)
                i, j = np.nonzero(np.bitwise_count(fp[a:ae, None] ^ fp[None, b:be]) <= radius)
                ahead = i + a < j + b
                _merge(lab, i[ahead] + a, j[ahead] + b)
    return lab


def links_of(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, fp), all different -> (a, b) links between nodes that connect all within the radius of each other."""

    def run(batches):
        held: list[np.ndarray] = []

        def stars():
            t = np.concatenate(held, 1)
            lab = linked(t[0], t[2].view(np.uint64), radius)
            i = np.flatnonzero(lab != np.arange(len(lab)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(t[1, i]), pa.array(t[1, lab[i]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            if held and held[-1][0, -1] != now[0, 0]:
                yield stars()
            last = np.flatnonzero(now[0] != now[0, -1])  # what precedes the last bucket
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                held.append(now[:, :cut])
                yield stars()
            held.append(now[:, cut:])
        if held:
            yield stars()

    keys = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(radius, distinct.count(), TILE))))
    dealt = distinct.select(F.explode(keys).alias("g"), "node", "fp")
    large = Written(dealt.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("g", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "large")
    if large.df.take(1):
        own, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("other")
        split = dealt.join(sized(large.df, 16), "g", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        dealt = split.select(F.when(F.col("parts").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least(own, other), F.greatest(own, other))).alias("g"), "node", "fp")
    return dealt.repartition("g").sortWithinPartitions("g", F.bit_count("fp")).mapInArrow(tidy(run), "a long, b long")


def classes(printed: DataFrame, radius: int = RADIUS) -> Written:
    """(doc_id, node, fp) rows -> table (node, root, component_id) over the distinct nodes; root names the component."""
    least = Written(printed.groupBy("node", "fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    star = components(links_of(least.df.drop("rep"), radius))
    members = star.df.toDF("node", "root")
    members = members.union(members.select("root", "root").distinct())
    reps = Written(members.join(least.df.select("node", "rep"), "node"), "members")
    star.drop()
    small = Written(reps.df.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    named = Written(reps.df.join(sized(small.df, 16), "root").select("node", "root", "component_id"), "members")
    out = least.df.select("node", "rep").join(sized(named.df, 24), "node", "left")
    alone = F.col("root").isNull()
    table = Written(out.select("node", F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"), F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id")), "classes")
    for t in (least, reps, small, named):
        t.drop()
    return table


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) per row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    printed = Written(fingerprints(slim, shingle).withColumn("node", F.col("fp")), "printed")
    found = classes(printed.df, radius)
    out = printed.df.join(sized(found.df, 24), "node")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one of least id (null last).

    Links are pairs whose shingle sets have this Jaccard similarity at least, compared exactly (`nearcopies`);
    equal sets, empty ones too, are one.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    slim = docs.select(key.alias("k"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    printed = Written(nearcopies.signed(slim, shingle), "printed")
    found = components(nearcopies.links(printed.df, slim, shingle, similarity))
    roots = sized(found.df.toDF("node", "root"), 16)
    named = Written(printed.df.select("k", "doc_id", "node").join(roots, "node", "left").select("k", "doc_id", F.coalesce("root", "node").alias("root")), "named")
    first = Written(named.df.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).getField("k").alias("winner"), F.count("*").alias("n")).where("n > 1"), "winners")
    dropped = Written(named.df.join(sized(first.df, 24), "root").where("k <> winner").select("k").distinct(), "dropped")
    again = Written(named.df.join(sized(first.df, 24), "root").where("k = winner").groupBy("k").count().where("count > 1").select("k"), "repeated")
    for t in (printed, found, named, first):
        t.drop()
    kept = docs.withColumn("__sim_k", key).join(sized(dropped.df.toDF("__sim_k"), 8), "__sim_k", "left_anti")
    if again.df.count():  # rows equal in id and text: one of them stays
        few = sized(again.df.toDF("__sim_k"), 8)
        kept = kept.join(few, "__sim_k", "left_anti").unionByName(kept.join(few, "__sim_k", "left_semi").dropDuplicates(["__sim_k"]))
    return kept.select(*docs.columns)
