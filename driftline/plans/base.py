"""The stand-in change stream over the `events` table, in Spark and in SQL.

lsn grows with event_id, ten events share a transaction, user_id is the row's key, the kind of event gives
the operation, versions are hours (so that they tie) and the kind of event is the writing client.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.tables import scan

CHANGES = """changes AS (SELECT event_id AS seq, event_id * 16 + 16777216 AS lsn, event_id // 10 AS xid,
 CASE user_id % 3 WHEN 0 THEN 'users' WHEN 1 THEN 'carts' ELSE 'orders' END AS "table", user_id AS pk,
 CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
 't' || (user_id % 4) AS tenant, event_type, value, ts, date_trunc('hour', ts) AS version FROM events)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scan(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), (F.col("event_id") * 16 + 16777216).alias("lsn"), F.expr("event_id div 10").alias("xid"),
        F.element_at(F.array(*map(F.lit, ("users", "carts", "orders"))), (F.col("user_id") % 3 + 1).cast("int")).alias("table"), F.col("user_id").alias("pk"),
        F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("operation"),
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant"), "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("version"),
    )


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
