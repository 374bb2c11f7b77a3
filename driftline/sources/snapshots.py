"""Snapshots as files: start, chunks, schema, descriptor or error, each under its tenant, table and snapshot id."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from driftline.operators.snapshot import descriptor
from driftline.sources.scratch import remove
from driftline.sources.tables import layout

_ERROR = "tenant string, table string, snapshot_id string, status string, error_type string, error_message string, available_tables array<string>"


def place(path: str, kind: str, tenant: str, table: str, snapshot_id: str) -> str:
    """kind: starts, chunks, schemas, descriptors or errors. Readers of `path/kind` prune by tenant, table and id."""
    parts = {"tenant": tenant, "table": table, "snapshot_id": snapshot_id}
    return "/".join([path.rstrip("/"), kind, *(f"{k}={quote(v, safe='')}" for k, v in parts.items())])


def purge(spark: SparkSession, path: str, tenant: str, table: str, snapshot_id: str) -> None:
    """Remove the chunks and the schema of a snapshot that was not finished; no other snapshot's."""
    for kind in ("chunks", "schemas"):
        remove(spark, place(path, kind, tenant, table, snapshot_id))


def produce(chunks: DataFrame, path: str, tenant: str, table: str, snapshot_id: str, lsn: int, pk: tuple[str, ...] = (), available: tuple[str, ...] = ()) -> None:
    """Write `chunks` (rows with their chunk): the start message with the mark, then the chunks, the schema and at last the
    descriptor, so whoever finds a descriptor finds all before it. An id that comes again replaces its own files. If
    anything fails, its chunks go, an error row of type generation_failed says so, and the error is raised."""
    spark = chunks.sparkSession
    at = lambda kind: place(path, kind, tenant, table, snapshot_id)
    spark.createDataFrame([(lsn, "starting")], "lsn long, status string").coalesce(1).write.mode("overwrite").parquet(at("starts"))
    try:
        chunks.write.mode("overwrite").partitionBy("chunk").parquet(at("chunks"))
        layout(chunks.drop("chunk"), pk).coalesce(1).write.mode("overwrite").parquet(at("schemas"))
        stored = spark.read.schema(chunks.schema).parquet(at("chunks"))
        descriptor(stored, table, snapshot_id, lsn).drop("table", "snapshot_id").write.mode("overwrite").parquet(at("descriptors"))
    except Exception as e:
        purge(spark, path, tenant, table, snapshot_id)
        row = (tenant, table, snapshot_id, "failed", "generation_failed", str(e)[:2000], list(available))
        spark.createDataFrame([row], _ERROR).drop("tenant", "table", "snapshot_id").coalesce(1).write.mode("overwrite").parquet(at("errors"))
        raise
