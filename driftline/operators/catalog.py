"""Catalog joins, payload shaping, widths by type, write grants, retention, counters."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalars import row_bytes


def layouts(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """Columns with their place in the key: attributes left-joined to the unnested key of each table's index.
    attributes: table, ordinal, name, type; indexes: table, key (array of column ordinals, in key order)."""
    keys = indexes.select("table", F.posexplode_outer("key").alias("pos", "ordinal")).select("table", "ordinal", (F.col("pos") + 1).alias("pk_ordinal"))
    return attributes.join(keys, ["table", "ordinal"], "left")


def published(publications: DataFrame, tables: DataFrame, attributes: DataFrame, types: DataFrame) -> DataFrame:
    """publication, table, column, type name: inner joins over the catalog; the small dimensions are Spark's to broadcast."""
    return publications.join(tables, "table_id").join(attributes, "table_id").join(types, "type_id")


def with_old(rows: DataFrame, old: str = "old") -> DataFrame:
    """The payload with old values under `old.<column>`."""
    prefixed = F.transform_keys(old, lambda k, _: F.concat(F.lit("old."), k))
    return rows.withColumn("data", F.map_concat("data", F.coalesce(prefixed, F.create_map().cast("map<string,string>"))))


def without_unchanged(rows: DataFrame) -> DataFrame:
    """Unchanged columns are absent from the payload; null ones stay."""
    return rows.withColumn("data", F.map_filter("data", lambda k, _: ~F.array_contains("unchanged", k)))


def view(rows: DataFrame, excluded: list[str]) -> DataFrame:
    return rows.drop(*excluded)


def required(nullable: Column, default: Column) -> Column:
    """A writer has to give a column that is not nullable and has no default."""
    return ~nullable & default.isNull()


def width_of(df: DataFrame) -> Column:
    """Row width by type: bytes of text and binary, of the JSON text of nested types, a constant for fixed ones."""
    variable, fixed = [], 0
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            variable.append(F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            variable.append(F.to_json(f.name))
        else:
            fixed += 1
    return row_bytes(variable, fixed)


def widest_rows(tables: dict[str, DataFrame], limit: int) -> DataFrame:
    """Widest stored row of each table, and whether it fits the limit."""
    each = [df.agg(F.max(width_of(df)).alias("max_bytes")).select(F.lit(name).alias("table"), "max_bytes") for name, df in tables.items()]
    out = each[0]
    for df in each[1:]:
        out = out.union(df)
    return out.withColumn("fits", F.coalesce(F.col("max_bytes") < limit, F.lit(True)))


def oversized_defaults(defaults: DataFrame, limit: int) -> DataFrame:
    """Column defaults (as text) that alone reach the limit."""
    return defaults.where(F.octet_length("default_text") >= limit).select("table", "column", F.octet_length("default_text").alias("bytes"))


def tenants_of(grants: DataFrame) -> DataFrame:
    return grants.groupBy("principal").agg(F.array_join(F.array_sort(F.collect_set("tenant")), ",").alias("tenants"))


def retained(log: DataFrame, at: str, now: Column, days: int = 2) -> DataFrame:
    """The DDL log keeps its last days."""
    return log.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def write_intent(tables: DataFrame) -> DataFrame:
    """tables: wanted, granted, key_allocated (by the database) -> verdict."""
    verdict = F.when(~F.col("wanted"), "not_wanted").when(F.col("key_allocated"), "key_allocated_by_database").when(~F.col("granted"), "grant_missing").otherwise("writable")
    return tables.withColumn("verdict", verdict)


def tenant_findings(tables: DataFrame) -> DataFrame:
    """tables: tenant_column (null if none), identity_columns, columns -> reason of refusal, null if none."""
    reason = F.when(F.col("tenant_column").isNull(), None).when(~F.array_contains("columns", F.col("tenant_column")), "no_tenant_column").when(~F.array_contains("identity_columns", F.col("tenant_column")), "tenant_not_in_replica_identity")
    return tables.withColumn("reason", reason)


def counters(frames: DataFrame) -> DataFrame:
    """Messages, data events, reconnects and queue use over a log of frames."""
    return frames.agg(F.count("*").alias("messages"), F.count_if(F.col("kind") == "data").alias("events"), F.count_if(F.col("kind") == "connect").alias("connects"), F.max("lsn").alias("last_lsn"))


def packed(value) -> bytes:
    """MessagePack of None, booleans, integers, floats, text, bytes, lists and string-keyed maps."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128 or -32 <= value < 0:
            return struct.pack(">B", value & 0xFF)
        return b"\xd3" + struct.pack(">q", value) if value < 1 << 63 else b"\xcf" + struct.pack(">Q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + struct.pack(">I", len(raw))) + raw
    if isinstance(value, bytes):
        return b"\xc6" + struct.pack(">I", len(value)) + value
    if isinstance(value, dict):
        return (bytes([0x80 | len(value)]) if len(value) < 16 else b"\xdf" + struct.pack(">I", len(value))) + b"".join(packed(k) + packed(v) for k, v in value.items())
    return (bytes([0x90 | len(value)]) if len(value) < 16 else b"\xdd" + struct.pack(">I", len(value))) + b"".join(map(packed, value))


def encoded(rows: DataFrame, keep: str, columns: list[str]) -> DataFrame:
    """(keep, body): each row's columns as one MessagePack map, in Arrow batches."""

    def run(batches):
        for batch in batches:
            body = [packed({n: r[n] for n in columns}) for r in batch.select(columns).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(keep)), pa.array(body, pa.binary())], names=[keep, "body"])

    names = list(dict.fromkeys([keep, *columns]))
    return rows.select(*names).mapInArrow(run, T.StructType([rows.schema[keep], T.StructField("body", T.BinaryType())]))
