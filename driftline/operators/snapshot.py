"""Snapshots: widths, keyset order, byte-bounded chunks, descriptors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.sources.tables import ordered_prefix_sum


def widths(rows: DataFrame, size: Column, budget: int) -> DataFrame:
    """Widest and mean row; too_wide: a row alone is over the budget, so no chunk may be sent."""
    out = rows.agg(F.max(size).alias("max_bytes"), F.floor(F.avg(size)).alias("avg_bytes"))
    return out.withColumn("too_wide", F.coalesce(F.col("max_bytes") >= budget, F.lit(False)))


def even_chunks(rows: DataFrame, running: str, budget: int) -> DataFrame:
    """Chunk by running total: order-preserving, fully parallel; a chunk may exceed the budget by one row."""
    return rows.withColumn("chunk", F.floor((F.col(running) - 1) / budget))


def packed_chunks(rows: DataFrame, keys: list[str], size: str, budget: int, segment: int = 1024) -> DataFrame:
    """Greedy chunks in key order: each is within the budget, or one row. Adds chunk (segment * 2**32 + number).

    A segment is a stretch of `segment` budgets of the running total; chunks are packed in each, row by row with no list
    held, and also end where a segment does. So the result depends on the rows alone, not on how they are dealt. Keys are
    unique; null sizes count 0."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    running = ordered_prefix_sum(rows, keys, n, "__running").withColumn("__n", n)
    parted = running.withColumn("__segment", F.expr(f"(__running - __n) div {budget * segment}")).drop("__running")

    def run(batches):
        open_, chunk, used = None, 0, 0
        for batch in batches:
            out = []
            for part, more in zip(batch.column("__segment").to_pylist(), batch.column("__n").to_pylist(), strict=True):
                if part != open_:
                    open_, chunk, used = part, 0, 0
                elif used and used + more > budget:
                    chunk, used = chunk + 1, 0
                used += more
                out.append((part << 32) + chunk)
            yield batch.append_column("chunk", pa.array(out, pa.int64()))

    ordered = parted.repartition("__segment").sortWithinPartitions("__segment", *keys)
    return ordered.mapInArrow(run, T.StructType([*parted.schema.fields, T.StructField("chunk", T.LongType())])).drop("__segment", "__n")


def final_flags(pages: DataFrame, all_keys: DataFrame, key: str) -> DataFrame:
    """A chunk is the last only if no row lies past its last key, however short it is."""
    end = all_keys.agg(F.max(key).alias("__end"))
    return pages.crossJoin(F.broadcast(end)).withColumn("final", F.col("last_key") >= F.col("__end")).drop("__end")


def descriptor(chunks: DataFrame, table: str, snapshot_id: str, lsn: int) -> DataFrame:
    """One row, written after the chunks."""
    out = chunks.agg(F.count("*").alias("row_count"), F.count_distinct("chunk").alias("batch_count"))
    return out.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(table).alias("table"), F.lit(lsn).cast("long").alias("lsn"), "row_count", "batch_count")


def complete(applied: DataFrame, described: DataFrame) -> DataFrame:
    """Does the number of rows applied equal the descriptor's?"""
    return described.join(applied.groupBy("table").agg(F.count("*").alias("applied")), "table", "left").withColumn("complete", F.coalesce("applied", F.lit(0)) == F.col("row_count"))


def freshness(descriptors: DataFrame, streams: DataFrame) -> DataFrame:
    """fresh: the stream still holds all after the snapshot. An empty stream is stale, an untrimmed one fresh."""
    joined = descriptors.join(streams, "table", "left")
    fresh = F.when(F.col("first_seq").isNull(), False).when(F.col("first_seq") <= 1, True).otherwise(F.col("lsn") >= F.col("oldest_lsn"))
    return joined.withColumn("fresh", fresh)


def as_of(descriptors: DataFrame, streams: DataFrame) -> DataFrame:
    """The newest snapshot per table that the retained stream continues."""
    ok = descriptors.join(streams.select("table", "oldest_lsn"), "table").where("lsn >= oldest_lsn")
    return ok.groupBy("table").agg(F.max_by("snapshot_id", F.struct("lsn", "snapshot_id")).alias("snapshot_id"), F.max("lsn").alias("lsn"))


def key_ordinals(layout: DataFrame) -> DataFrame:
    """Are a table's key ordinals exactly 1..n?"""
    got = layout.where("pk_ordinal is not null").groupBy("table").agg(F.sort_array(F.collect_list("pk_ordinal")).alias("o"))
    return got.select("table", (F.col("o") == F.sequence(F.lit(1), F.size("o"))).alias("key_ok"))


def errors(requests: DataFrame, refusals: DataFrame, monitored: DataFrame) -> DataFrame:
    """Why a requested snapshot is not made."""
    r = requests.join(refusals.where("active").select("table", F.lit(True).alias("refused")), "table", "left").join(monitored.select("table", F.lit(True).alias("known")), "table", "left")
    return r.withColumn("error_type", F.when(F.col("refused"), "table_refused").when(F.col("known").isNull(), "table_not_monitored")).drop("refused", "known").where("error_type is not null")


def running_total(rows: DataFrame, by: list[str], keys: list[str], size: Column, out: str = "running") -> DataFrame:
    return rows.withColumn(out, F.sum(size).over(Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
