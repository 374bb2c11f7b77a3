"""Repeated 400-byte strings, found with sparse suffix arrays around content-chosen anchors.

Every LENGTH-byte window of a text has one anchor: its ANCHOR-byte gram with the least hash. Equal windows have
equal anchors at equal offsets, so only texts around an anchor that occurs twice can repeat. Neighbouring
windows with the same anchor form a run. Runs equal in all bytes (by a hash of 128 bits) repeat entirely, and are
counted with map-side combining, so copies, however many, never meet in one task. Of the other runs of an anchor
one per distinct content is fetched; the suffixes that start at the anchor and the reversed prefixes that end
there are sorted deep-shallow, and their common prefixes tell, byte for byte, which windows repeat.

An anchor with more than CROWD contents is dealt out finer: its windows are taken PIECE offsets at a time, and
contents meet only where they agree in all bytes that such windows share; equal pieces are again counted with
map-side combining and meet once. Where more than CROWD pieces still agree, they are dealt out window by window, and
equal windows (128 bits) are counted. What holds for pieces and windows is put together per content. So a task sorts
CROWD contents of an anchor at most.

Defined cases: null and short texts have nothing removed; repeated rows remove each other's bytes where long
enough; null ids each give their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sieve, Written, sized, slices, tidy
from .suffixes import deep_shallow

LENGTH, ANCHOR = 400, 200
SEGMENT = 1 << 20
CROWD, PIECE = 256, 25
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


class Powers:
    """Powers of the hash base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            run = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            self.up, self.down = run(np.uint64(_BASE)), run(np.uint64(pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def gram_hashes(s: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    n = len(s)
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[size:] - total[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.uint64(_M64))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: bytes, powers: Powers, length: int = LENGTH, anchor: int = ANCHOR) -> list[tuple[int, int, int, int, int, int]]:
    """(first byte, end, anchor's place, anchor's hash, content's hash in halves) of each run of windows."""
    out = []
    s = np.frombuffer(data, np.uint8)
    low = np.uint64((1 << 24) - 1)
    for base in range(0, len(s) - length + 1, SEGMENT):
        part = s[base : base + SEGMENT + length - 1]
        h = gram_hashes(part, anchor, powers)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        place = (least[first] & low).astype(np.int64)
        hashes = h[place].view(np.int64)
        for a, b, p, g in zip((first + base).tolist(), (last + base + length).tolist(), (place + base).tolist(), hashes.tolist(), strict=True):
            out.append((a, b, p, g, *halves(data[a:b])))
    return out


def halves(data: bytes, seed: int = 0) -> tuple[int, int]:
    """128-bit hash as two signed numbers."""
    x = xxhash.xxh3_128_intdigest(data, seed)
    return (x >> 64) - (1 << 63), (x & _M64) - (1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a content key: rows equal in id and text share it, and share their result."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.select("id", "text", F.xxhash64("id", "text").alias("k"), F.hash("text", "id").alias("k2"))


def _anchors(keyed: DataFrame, length: int, anchor: int) -> DataFrame:
    names = ["k", "k2", "a", "b", "p", "h", "c", "d"]

    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            own: list[list] = [[] for _ in names]
            for text, k, k2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "replace")
                if len(data) >= length:
                    rows = runs_of(data, powers, length, anchor)
                    for column, values in zip(own[2:], zip(*rows, strict=True), strict=True):
                        column += values
                    own[0] += [k] * len(rows)
                    own[1] += [k2] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(own, (pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3), strict=True)], names=names)

    long = F.octet_length("text") >= length
    return keyed.where(long).select("text", "k", "k2").mapInArrow(tidy(run), "k long, k2 int, a int, b int, p int, h long, c long, d long")


def repeated_parts(texts: list[tuple[bytes, int]], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """For contents (bytes, anchor's place) of one anchor, all different: which part of each is covered by windows
    that another has too, as (first, end), or None."""
    m = len(texts)
    ranks, lcps = [], []
    for side in ([t[at:] for t, at in texts], [t[:at][::-1] for t, at in texts]):
        order, lcp = deep_shallow(side)
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        ranks.append(rank)
        lcps.append(lcp)
    (right, left), (lcp_r, lcp_l) = ranks, lcps
    most, least = np.full(m, -1), np.full(m, length + 1)  # bytes before the anchor in repeated windows
    if m <= 64:
        both = []
        for rank, lcp in ((right, lcp_r), (left, lcp_l)):
            grid = np.zeros((m, m), np.int64)
            for i in range(m - 1):
                grid[i, i + 1 :] = np.minimum.accumulate(lcp[i + 1 :])
            grid += grid.T
            both.append(grid[np.ix_(rank, rank)])
        r, before = both
        ok = r + before >= length
        np.fill_diagonal(ok, False)
        most = np.where(ok, before, -1).max(1)
        least = np.where(ok, length - r, length + 1).min(1)
    else:
        for d in range(max(at for _, at in texts) + 1):
            ahead = np.cumsum(lcp_r < length - d)[right]
            behind = np.cumsum(lcp_l < d)[left]
            key = behind * (m + 1) + ahead
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = count[at] > 1
            most[hit] = d
            least[hit & (least > length)] = d
    return [(at - int(x), at - int(y) + length) if x >= 0 else None for (_, at), x, y in zip(texts, most, least, strict=True)]


def pieces_of(data: bytes, a: int, b: int, p: int, length: int) -> list[tuple[int, int, int, int]]:
    """(shared bytes' hash, first byte, end, first window offset) of the pieces of a run: windows by the number of
    bytes before the anchor, PIECE at a time."""
    out = []
    for j in range((length - (b - p)) // PIECE, (p - a) // PIECE + 1):
        low, high = max(j * PIECE, length - (b - p)), min(j * PIECE + PIECE - 1, p - a)
        shared = data[p - j * PIECE : p - (j * PIECE + PIECE - 1) + length]
        out.append((xxhash.xxh3_64_intdigest(shared, j) - (1 << 63), p - high, p - low + length, high))
    return out


_PIECES = "h long, c long, d long, g long, q long, r long, shift int, at int, content binary"


def _fetch(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted: (k, k2, runs: array of (h, c, d, a, b, p, crowd)) -> pieces to compare. g tells the pieces that can agree;
    q and r are the piece's own hash, shift its place in the content, at the anchor's place in the piece."""
    names = [f.split()[0] for f in _PIECES.split(", ")]
    kinds = (*[pa.int64()] * 6, pa.int32(), pa.int32(), pa.binary())

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text, runs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                data = text.encode("utf-8", "replace")
                for r in runs:
                    a, b, p = r["a"], r["b"], r["p"]
                    if not r["crowd"]:
                        rows.append((r["h"], r["c"], r["d"], 0, r["c"], r["d"], 0, p - a, data[a:b]))
                        continue
                    for g, first, end, before in pieces_of(data, a, b, p, length):
                        piece = data[first:end]
                        rows.append((r["h"], r["c"], r["d"], g, *halves(piece), first - a, before, piece))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=names)

    return keyed.select("text", "k", "k2").join(wanted, ["k", "k2"]).select("text", "runs").mapInArrow(tidy(run), _PIECES)


_PART = "h long, g long, q long, r long, lo int, hi int"


def _compare(contents: DataFrame, length: int) -> DataFrame:
    """(h, g, q, r, at, content), all different -> (h, g, q, r, lo, hi): the part of each that repeats in another of its group."""

    def run(batches):
        held: list = []

        def judged(rows):
            if len(rows) > 1:
                for (h, g, q, r, _, _), part in zip(rows, repeated_parts([(t, at) for *_, at, t in rows], length), strict=True):
                    if part:
                        yield h, g, q, r, *part

        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[-1][:2] != row[:2]:
                    out += judged(held)
                    held = []
                held.append(row)
            yield _parts(out)
        yield _parts(list(judged(held)))

    return contents.repartition("h", "g").sortWithinPartitions("h", "g").select("h", "g", "q", "r", "at", "content").mapInArrow(tidy(run), _PART)


def _parts(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(),) * 4 + (pa.int32(),) * 2, strict=True)], names=["h", "g", "q", "r", "lo", "hi"])


def _by_window(contents: DataFrame, length: int) -> DataFrame:
    """The same for groups too large to meet: windows at the same offset from the anchor are counted, wherever they are."""
    names = ["h", "g", "q", "r", "o", "x", "y"]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for h, g, q, r, at, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(h, g, q, r, o, *halves(content[o : o + length], at - o)) for o in range(len(content) - length + 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "o" else pa.int64()) for n, v in zip(names, columns, strict=True)], names=names)

    each = Written(contents.select("h", "g", "q", "r", "at", "content").mapInArrow(tidy(run), "h long, g long, q long, r long, o int, x long, y long"), "windows")
    again = Written(each.df.groupBy("h", "g", "x", "y").count().where("count > 1").drop("count"), "windows-again")
    out = Written(each.df.join(again.df, ["h", "g", "x", "y"]).groupBy("h", "g", "q", "r").agg(F.min("o").alias("lo"), (F.max("o") + length).alias("hi")), "windows-parts")
    each.drop()
    again.drop()
    return out.df


def covered(keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> Written:
    """(k, k2, spans: array of (first, end)) of the documents that have repeated bytes; spans may overlap."""
    anchors = Written(_anchors(keyed, length, anchor), "anchors")
    ends = (f("c").alias(f"c{i}") for i, f in enumerate((F.min, F.max)))
    twice = anchors.df.groupBy("h").agg(F.count("*").alias("n"), *ends, F.min("d").alias("d0"), F.max("d").alias("d1")).where("n > 1")
    twice = Written(twice.select("h", F.expr("c0 = c1 and d0 = d1").alias("same")), "anchors-twice")
    members = Written(anchors.df.join(twice.df, "h"), "anchors-members")
    anchors.drop()
    twice.drop()
    mixed = members.df.where("not same")
    content, piece = ["h", "c", "d"], ["h", "g", "q", "r"]
    kinds = Written(mixed.groupBy(*content).agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("k", "k2", "a", "b", "p"))), "contents")
    crowds = Written(kinds.df.groupBy("h").count().where(F.col("count") > CROWD).select("h", F.lit(True).alias("crowd")), "crowds")
    runs = kinds.df.join(sized(crowds.df, 16), "h", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    wanted = Written(runs.groupBy("k", "k2").agg(F.collect_list(F.struct("h", "c", "d", "a", "b", "p", "crowd")).alias("runs")), "wanted")
    near = Sieve(wanted.df, "k").marked(keyed, "k", "near").where("near").drop("near")
    pieces = Written(_fetch(near, wanted.df, length), "pieces")
    crowded = pieces.df.where("g <> 0")
    once = Written(crowded.groupBy(*piece).agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("content").alias("content")), "pieces-once")
    dense = Written(once.df.groupBy("h", "g").count().where(F.col("count") > CROWD).select("h", "g"), "dense")
    few = sized(dense.df, 16)
    small = pieces.df.where("g = 0").select(*piece, "at", "content").union(once.df.drop("n").join(few, ["h", "g"], "left_anti").select(*piece, "at", "content"))
    found = _compare(small, length)
    if dense.df.take(1):
        found = found.union(_by_window(once.df.join(few, ["h", "g"]), length))
    parts = Written(found, "parts")
    twins = once.df.where("n > 1").select(*piece, F.lit(0).alias("lo"), F.octet_length("content").alias("hi"))
    known = twins.union(parts.df.where("g <> 0").join(once.df.where("n = 1").select(*piece), piece).select(*piece, "lo", "hi"))
    joint = crowded.select(*content, "g", "q", "r", "shift").join(known, piece).groupBy(*content).agg(F.min(F.col("shift") + F.col("lo")).alias("lo"), F.max(F.col("shift") + F.col("hi")).alias("hi"))
    whole = kinds.df.where("n > 1").select(*content, F.lit(0).alias("lo"), (F.col("b") - F.col("a")).alias("hi"))
    alone = parts.df.where("g = 0").select("h", F.col("q").alias("c"), F.col("r").alias("d"), "lo", "hi").union(joint)
    ruled = Written(whole.union(alone.join(kinds.df.where("n = 1").select(*content), content).select(*content, "lo", "hi")), "ruled")
    spans = members.df.where("same").select("k", "k2", "a", "b").union(
        mixed.join(ruled.df, content).select("k", "k2", (F.col("a") + F.col("lo")).alias("a"), (F.col("a") + F.col("hi")).alias("b"))
    )
    # Rows equal in id and text give each span again: sets are combined before the shuffle.
    out = Written(spans.groupBy("k", "k2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    for t in (members, kinds, crowds, wanted, pieces, once, dense, parts, ruled):
        t.drop()
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; kept: the remaining bytes."""
    keyed = _keyed(docs, id_col, text_col)
    found = covered(keyed, length, anchor)

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                cut = merged([(s["a"], s["b"]) for s in spans or ()])
                kept, done = [], 0
                for a, b in cut:
                    kept.append(data[done:a])
                    done = b
                left = b"".join([*kept, data[done:]])
                out.append((len(data), len(data) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # Texts without repeated bytes stay where they are; the others meet their spans.
    marked = Sieve(found.df, "k").marked(keyed, "k", "cut")
    whole = marked.where("not cut").select("id", "text", F.lit(None).cast(found.df.schema["spans"].dataType).alias("spans"))
    joined = marked.where("cut").join(found.df, ["k", "k2"], "left").select("id", "text", "spans").union(whole)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(tidy(run), T.StructType(fields))
