"""Mixing sources to target weights by entropy balancing.

Document rates are those nearest to one in relative entropy that no cap breaks and that bring each source's tokens
to its target: min(cap, exp(lambda . x)), x being a document's token constraint (its tokens, in units of its source's
mean, for its own source). So rates differ within a source: the multiplier times a document's length. The
multipliers solve the convex dual by safeguarded Newton steps, whose gradient and curvature are sums over documents,
taken by Spark; as they depend on source and length only, documents are counted by both once.

Rates become copies: the whole part for all, one more for documents in the order of hash / fraction (sequential
Poisson sampling) until the source's words are spent; further rounds fill what is left, less than one document,
with documents that still fit, in the order of a hash. Decisions are a threshold per source and round plus the few documents at the threshold, so applying them to
the texts needs no shuffle of texts. Sources are rows of tables throughout; the driver sees sums over them only.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last in order;
rows equal in id, text and source are taken together or not at all; sources without words have target 0; an empty
table gives an empty result; ties in the order are broken by a hash of id and text; other columns are kept by `mixed`,
but for those named like the ones that it adds, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Written, fits, sized

WEIGHTS, SHARE, CAP, ROUNDS, STEPS = (3.0, 1.0, 2.0), 1.5, 2.0, 3, 60
#: Files of tables with a row a source; relative distance from the target at which a multiplier is found.
FILES, NEAR = 8, 1e-8
ADDED = ("size", "source_size", "target", "taken", "copies")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(source: Column) -> Column:
    """Sources as join keys, null among them."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def ranked(sources: DataFrame) -> Written:
    """(source, ...), one row a source -> with `rank` from 0 by code point, null last: range partitions, each
    numbered by itself, and the numbers of rows before them."""
    ranged = sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    ranged = Written(ranged, "mix-ranged")
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in ranged.df.groupBy("part").count().collect()):  # a row a partition
        before.append((part, total))
        total += n
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    offsets = sources.sparkSession.createDataFrame(before, "part int, before long")
    out = Written(ranged.df.withColumn("rank", own).join(F.broadcast(offsets), "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before"), "mix-ranked", FILES)
    ranged.drop()
    return out


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(rank, source_size, ...) with target: shares by weight, stopped at cap times the size, the excess reshared. What a
    unit of weight gets grows from pass to pass until no further source is stopped."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sources.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(cap)})
    each, seen = 0.0, None
    while True:
        free = F.lit(each) * F.col("weight") <= F.col("most")
        total, stopped, wanted, n = rows.agg(F.sum("source_size"), F.sum(F.when(free, 0.0).otherwise(F.col("most"))), F.sum(F.when(free, F.col("weight"))), F.count_if(free)).first()
        if n == seen or not n:
            break
        each, seen = (share * (total or 0) - stopped) / wanted, n
    target = F.when(F.lit(each) * F.col("weight") <= F.col("most"), F.lit(each) * F.col("weight")).otherwise(F.col("most"))
    return rows.withColumn("target", target).drop("weight", "most")


def rate_of(size: Column, lam: Column, mean: Column, cap: float) -> Column:
    """A document's rate; a null multiplier stands for an infinite one: the cap."""
    return F.when(lam.isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(lam * size / mean)))


def solve_dual(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> Written:
    """cells: (s, size, n), sizes above 0; sources: (s, source_size, target, mean, ...) -> with the multiplier `lam`.

    Newton on sum mean * (capped exponential's integral) - lambda . target, one multiplier a source, all at once;
    a step that leaves the bracket of the root halves it instead. Where the target takes every document at the
    cap there is no finite root, and `lam` is null."""
    top = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))
    start = F.when(~top, F.log(F.col("target") / F.col("source_size")))
    names = sources.columns
    state = Written(sources.withColumns({"lam": start, "low": F.lit(-math.inf), "high": F.lit(math.inf), "off": F.when(~top, F.lit(1.0)).otherwise(0.0)}), "mix-dual", FILES)
    small = fits(state.df.count(), 40)
    for _ in range(STEPS):
        open_ = state.df.where(F.col("off") > NEAR).select("s", "lam", "mean")
        open_ = F.broadcast(open_) if small else open_
        rate, size = rate_of(F.col("size"), F.col("lam"), F.col("mean"), cap), F.col("size")
        tokens = F.col("n") * size * rate
        sums = cells.join(open_, "s").groupBy("s").agg(F.sum(tokens).alias("got"), F.sum(F.when(rate < cap, tokens * size / F.col("mean")).otherwise(0.0)).alias("curve"))
        now = state.df.join(F.broadcast(sums.coalesce(FILES)) if small else sums, "s", "left")
        gap = F.col("target") - F.col("got")
        low, high = F.when(gap > 0, F.col("lam")).otherwise(F.col("low")), F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + F.when(F.col("curve") > 0, gap / F.col("curve")).otherwise(F.lit(math.inf))
        bound = F.when(high == math.inf, F.col("lam") + 1 + F.abs("lam")).when(low == -math.inf, F.col("lam") - 1 - F.abs("lam")).otherwise((low + high) / 2)
        step = F.when((newton > low) & (newton < high) & (F.abs(newton - F.col("lam")) <= 1 + F.abs("lam")), newton).otherwise(bound)
        off = F.when(F.col("got").isNull(), 0.0).otherwise(F.abs(gap) / F.greatest(F.lit(1.0), F.col("target")))
        moved = F.when(off > NEAR, step).otherwise(F.col("lam"))
        nxt = Written(now.select(*names, moved.alias("lam"), F.when(F.col("got").isNull(), F.col("low")).otherwise(low).alias("low"), F.when(F.col("got").isNull(), F.col("high")).otherwise(high).alias("high"), off.alias("off")), "mix-dual", FILES)
        state.drop()
        state = nxt
        if not state.df.where(F.col("off") > NEAR).take(1):
            break
    return state


class Mix:
    """Decisions for a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP):
        self.cap = cap
        self.units = Written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *unit(id_col, text_col, source_col)), "mix-units")
        cells = Written(self.units.df.groupBy("s", "source", "size").agg(F.count("*").alias("n")), "mix-cells")
        sizes = cells.df.groupBy("s", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
        order = ranked(sizes)
        aimed = Written(with_targets(order.df, weights, share, cap).withColumn("mean", F.col("source_size") / F.greatest(F.lit(1), F.col("docs"))).select("s", "source_size", "target", "mean"), "mix-targets", FILES)
        self.few = fits(aimed.df.count(), 64)
        worded = cells.df.where("size > 0").select("s", "size", "n")
        dual = solve_dual(worded, aimed.df.where("source_size > 0"), cap)
        rate = rate_of(F.col("size"), F.col("lam"), F.col("mean"), cap)
        base = worded.join(self._small(dual.df.select("s", "lam", "mean")), "s").groupBy("s").agg(F.sum(F.col("n") * F.col("size") * F.floor(rate + 1e-9)).alias("whole"))
        known = aimed.df.join(dual.df.select("s", "lam"), "s", "left").join(base, "s", "left")
        self.table = Written(known.select("s", "source_size", "target", "mean", "lam", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("whole", F.lit(0))).alias("need")), "mix-sources", FILES)
        for t in (cells, order, aimed, dual):
            t.drop()
        self.bins = 1 << max(4, -(-self.units.df.count().bit_length() // 2))  # about as many bins as documents in one
        self.picks = Written(self.units.df.select("s", "i", F.lit(0).alias("mask")).limit(0), "mix-picks", 1)
        self.picked = F.broadcast(self.picks.df)
        for k in range(ROUNDS):
            self._round(k)

    def _small(self, df: DataFrame) -> DataFrame:
        """A table with a row a source, for a join."""
        return F.broadcast(df) if self.few else df

    @staticmethod
    def _place(k: int) -> Column:
        """Where a document stands in its source's order, in 52 bits: in the first round hash / fraction, which is
        drawn into them so that 2**51 is where the hash equals the fraction; later the hash."""
        draw = (F.shiftrightunsigned(F.xxhash64(F.lit(k), "i", "size"), 12).cast("double") + 0.5) / float(1 << 52)
        return F.floor((draw if k else draw / (draw + F.col("part"))) * float((1 << 52) - 1)).cast("long")

    def _may(self, k: int) -> Column:
        """May round k give the document another copy?"""
        return (F.col("size") > 0) & (F.col("base") + F.col("more") + 1 <= self.cap) if k else F.col("part") > 1e-9

    def _chosen(self, df: DataFrame, k: int) -> DataFrame:
        """`df` (i, s, size, ...) with its source's columns, base and fraction (`part`) of its rate and `more`: the copies
        that the first k rounds give besides."""
        rate = F.when(F.col("size") > 0, rate_of(F.col("size"), F.col("lam"), F.col("mean"), self.cap)).otherwise(0.0)
        df = df.join(self._small(self.table.df), "s").withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9).cast("long"))
        df = df.withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).join(self.picked, ["s", "i"], "left").withColumn("more", F.lit(0))
        for j in range(k):
            at_edge = F.coalesce(F.col("mask").bitwiseAND(F.lit(1 << j)) > 0, F.lit(False))
            takes = self._may(j) & (F.col("size") <= F.col(f"limit{j}")) & ((self._bin(self._place(j)) < F.col(f"edge{j}")) | at_edge)
            df = df.withColumn("more", F.col("more") + F.coalesce(takes, F.lit(False)).cast("int"))
        return df

    def _bin(self, z: Column) -> Column:
        return F.shiftright(z, 52 - int(math.log2(self.bins)))

    def _round(self, k: int) -> None:
        """Find each source's edge: bins below it are chosen whole, documents in it as long as they fit. The table of
        sources gets columns edge and limit (the largest size); picks at the edge get a bit."""
        units = self._chosen(self.units.df, k)
        if k:
            got = units.groupBy("s").agg(F.sum(F.col("size") * F.col("more")).alias("got")).coalesce(FILES)
            left = self.table.df.join(self._small(got), "s").select("s", (F.col("need") - F.col("got")).alias("rest"), (F.col("need") - F.col("got")).alias("most"))
        else:
            left = self.table.df.select("s", F.col("need").alias("rest"), F.lit(float(1 << 62)).alias("most"))
        left = Written(left, "mix-left", FILES)
        fit = units.where(self._may(k)).withColumn("z", self._place(k)).join(self._small(left.df), "s").where("size <= most")
        fit = Written(fit.select("i", "s", "size", "rest", "z", self._bin(F.col("z")).alias("at")), "mix-fits")
        bins = fit.df.groupBy("s", "at").agg(F.sum("size").alias("tokens"), F.max("rest").alias("rest"))
        upto = bins.withColumn("upto", F.sum("tokens").over(Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        over = upto.where("upto > rest").groupBy("s").agg(F.min(F.struct("at", (F.col("upto") - F.col("tokens")).alias("below"))).alias("e")).coalesce(FILES)
        edges = left.df.join(self._small(over), "s", "left").select("s", F.coalesce("e.at", F.lit(self.bins).cast("long")).alias("edge"), (F.col("rest") - F.coalesce("e.below", F.lit(0))).alias("rest"), "most")
        edges = Written(edges, "mix-edges", FILES)
        inside = fit.df.drop("rest").join(self._small(edges.df), "s").where("at = edge").groupBy("s", "z", "i", "rest").agg(F.sum("size").alias("tokens"))
        run = inside.withColumn("upto", F.sum("tokens").over(Window.partitionBy("s").orderBy("z", "i").rowsBetween(Window.unboundedPreceding, 0)))
        picks = self.picks.df.union(run.where("upto <= rest").select("s", "i", F.lit(1 << k)))
        picks = Written(picks.groupBy("s", "i").agg(F.bit_or("mask").cast("int").alias("mask")), "mix-picks", 4 * FILES)
        table = self.table.df.join(self._small(edges.df.select("s", F.col("edge").alias(f"edge{k}"), F.col("most").alias(f"limit{k}"))), "s")
        table = Written(table, "mix-sources", FILES)
        for t in (fit, left, edges, self.table, self.picks):
            t.drop()
        self.table, self.picks, self.picked = table, picks, sized(picks.df, 32)

    def apply(self, df: DataFrame) -> DataFrame:
        """`df` (i, s, size, ...) with source_size, target, copies and taken."""
        out = self._chosen(df, ROUNDS)
        copies = F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(F.lit(0)).cast("long")
        return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def unit(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What decisions go by: i, s, size."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("i"), key_of(F.col(source_col)).alias("s"), size_of(F.col(text_col)).alias("size")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id, size, source_size, target, taken, copies) per row."""
    plan = Mix(docs, id_col, text_col, source_col, **how)
    return plan.apply(plan.units.df.select("id", "i", "s", "size")).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, taken and copies after their own columns."""
    plan = Mix(docs, id_col, text_col, source_col, **how)
    own = [c for c in docs.columns if c not in ADDED]
    whole = docs.select(F.struct(*(F.col(c) for c in own)).alias("row"), *unit(id_col, text_col, source_col))
    return plan.apply(whole).where("copies > 0").select("row.*", *ADDED)
