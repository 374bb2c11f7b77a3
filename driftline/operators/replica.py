"""Replicas: snapshot and changes folded into current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last event per key, deleted keys gone; whole rows, map-side combined."""
    rest = [c for c in events.columns if c not in key]
    top = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return top.select(*key, *(F.col(f"last.{c}").alias(c) for c in rest)).where("operation <> 'DELETE'")


def gated(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Events older than their table's snapshot go; one at the mark itself stays (strict <)."""
    joined = events.join(marks.select("table", "snapshot_lsn"), "table", "left")
    return joined.where(F.col("snapshot_lsn").isNull() | (F.col("lsn") >= F.col("snapshot_lsn"))).drop("snapshot_lsn")


def combined(snapshot: DataFrame, events: DataFrame, key: list[str], lsn: str = "lsn") -> DataFrame:
    """Snapshot rows (with the mark as lsn, before any event of that lsn) and the events past the gate."""
    base = snapshot.withColumns({"operation": F.lit("INSERT"), "__ord": F.lit(0)})
    rows = base.unionByName(events.withColumn("__ord", F.lit(1)), allowMissingColumns=True)
    return latest_rows(rows, key, [lsn, "__ord"]).drop("__ord")


def carried(events: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows after every event, unchanged columns carried forward. An unchanged column is named in `unchanged`; null is
    a value. A DELETE starts a new generation, so nothing is carried over it."""
    upto = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    born = events.withColumn("generation", F.sum((F.col("operation") == "DELETE").cast("int")).over(upto))
    life = Window.partitionBy(*key, "generation").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(F.when(~F.array_contains("unchanged", c), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(life)["v"]
    return born.withColumns({c: held(c) for c in columns})


def key_changes(events: DataFrame, key: str, old_key: str) -> DataFrame:
    """An update that moves the key becomes a DELETE of the old key and an upsert of the new one."""
    moved = (F.col("operation") == "UPDATE") & F.col(old_key).isNotNull() & ~F.col(old_key).eqNullSafe(F.col(key))
    gone = F.struct(F.col(old_key).alias(key), F.lit("DELETE").alias("operation"), F.lit(0).alias("ord"))
    here = F.struct(F.col(key).alias(key), F.when(moved, "INSERT").otherwise(F.col("operation")).alias("operation"), F.lit(1).alias("ord"))
    rest = [c for c in events.columns if c not in (key, "operation", old_key)]
    parts = F.explode(F.when(moved, F.array(gone, here)).otherwise(F.array(here)))
    return events.select(*rest, parts.alias("p")).select(*rest, "p.*")


def truncated(events: DataFrame, truncates: DataFrame) -> DataFrame:
    """A truncate removes all of its table's rows with a smaller lsn."""
    last = truncates.groupBy("table").agg(F.max("lsn").alias("truncate_lsn"))
    joined = events.join(last, "table", "left")
    return joined.where(F.col("truncate_lsn").isNull() | (F.col("lsn") > F.col("truncate_lsn"))).drop("truncate_lsn")


def raced(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """apply, hold or strip: an event with columns that no schema has yet is held; columns that an event older than
    the latest schema has and that schema lacks are stripped. events: table, lsn, columns; schemas: table, lsn, columns."""
    newest = schemas.groupBy("table").agg(F.max_by(F.struct(F.col("lsn").alias("schema_lsn"), F.col("columns").alias("known")), "lsn").alias("s")).select("table", "s.*")
    joined = events.join(newest, "table", "left")
    extra = F.array_except("columns", F.coalesce("known", F.array().cast("array<string>")))
    verdict = F.when(F.size(extra) == 0, "apply").when(F.col("lsn") < F.col("schema_lsn"), "strip").otherwise("hold")
    kept = F.when(verdict == "strip", F.array_intersect("columns", "known")).otherwise(F.col("columns"))
    return joined.withColumns({"verdict": verdict, "applied": kept}).drop("known", "schema_lsn", "columns")


def live(rows: DataFrame, tombstone: str) -> DataFrame:
    return rows.where(F.col(tombstone).isNull())


def whole_row_cache(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Replace, never merge: the last row per key as it came."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
