"""Connected components of link tables by alternating large-star and small-star steps.

Links stay distributed: every step is aggregation and join, written to the shared folder; the driver
sees only a row count and a checksum. A hub's rows are pre-aggregated before the shuffle and its join
side is split by AQE, so a component of any size is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

LINKS = "a long, b long"


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Each vertex's neighbours (larger ones, or smaller ones and itself) are tied to its minimum."""
    if large:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a")
    return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> Written:
    """(a, b) links, any direction, repeats and loops allowed -> table (a, b): b is the least vertex of
    a's component, for every a that isn't the least itself. No links give an empty table."""
    table = Written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _sum(table.df)
    while seen[0]:
        large = Written(_star(table.df, large=True), "links")
        small = Written(_star(large.df, large=False), "links")
        table.drop()
        large.drop()
        table, now = small, _sum(small.df)
        if now == seen:
            break
        seen = now
    return table
