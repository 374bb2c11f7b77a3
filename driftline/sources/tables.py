"""Sources and sinks over files: event logs, snapshots, key-value logs, queues, generators, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.config import keyset_predicate
from driftline.functions.scalars import source_type, sqlite_type
from driftline.sources.scratch import written


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16, from_lsn: int | None = None) -> DataFrame:
    """Append-only log as a stream; admission control is the back-pressure, the checkpoint is the acknowledged position.
    `from_lsn` is where a stream without a checkpoint starts: the predicate reaches the scan."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return log if from_lsn is None else log.where(F.col("lsn") >= from_lsn)


def resume(log: DataFrame, last_seq: int | None) -> DataFrame:
    """From the row after the last one seen, or all."""
    return log if last_seq is None else log.where(F.col("seq") > last_seq)


def current_lsn(log: DataFrame) -> DataFrame:
    return log.agg(F.max("lsn").alias("current_lsn"))


def unbatched(messages: DataFrame, body: str, element: str) -> DataFrame:
    """A body is one JSON object or an array of them -> one row per object."""
    is_array = F.trim(F.col(body)).startswith("[")
    parts = F.when(is_array, F.from_json(body, f"array<{element}>")).otherwise(F.array(F.from_json(body, element)))
    return messages.withColumn("item", F.explode(parts)).drop(body)


def layout(df: DataFrame, pk: tuple[str, ...] = ()) -> DataFrame:
    """(ordinal, name, type, sqlite_type, required, pk_ordinal) of a table; type is the source's name."""
    rows = [(i + 1, f.name, source_type(f.dataType.simpleString()), not f.nullable, pk.index(f.name) + 1 if f.name in pk else None) for i, f in enumerate(df.schema.fields)]
    out = df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, required boolean, pk_ordinal int")
    return out.withColumn("sqlite_type", sqlite_type(F.col("type")))


def page(df: DataFrame, keys: list[str], after: list | None, n: int) -> DataFrame:
    """Keyset page: seek, order by the full key, limit."""
    return df.where(keyset_predicate(keys, after)).orderBy(*keys).limit(n)


def publication(df: DataFrame, columns: list[str] | None = None, row_filter: str | None = None) -> DataFrame:
    """Column list and row filter reach the scan."""
    out = df.where(f"({row_filter})") if row_filter else df
    return out.select(*columns) if columns else out


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last value per key of an append log; map-side combined, so no key is too hot."""
    rest = [c for c in log.columns if c not in keys]
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return top.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def kv_view(log: DataFrame) -> DataFrame:
    """(key, value, seq, deleted) log -> live keys."""
    return latest(log, ["key"], ["seq"]).where("not deleted").drop("deleted")


def generated(spark: SparkSession, n: int, keys: int = 1000) -> DataFrame:
    """Deterministic rows of a create, update, delete loop."""
    kind = F.element_at(F.array(*map(F.lit, ("INSERT", "UPDATE", "UPDATE", "DELETE"))), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * 8).alias("lsn"), F.floor(F.col("id") / 100).alias("xid"), (F.xxhash64("id") % keys).alias("key"), kind.alias("operation"))


def write_log(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append sink, partitioned where readers prune."""
    (df.write.mode("append").partitionBy(*by) if by else df.write.mode("append")).parquet(path)


def replay_chunks(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(chunk, rows: array of arrays) -> one map per row, in chunk order."""
    rows = chunks.select("chunk", F.posexplode("rows").alias("n", "row"))
    return rows.select("chunk", "n", F.map_from_arrays(F.array(*map(F.lit, columns)), F.col("row")).alias("data"))


def _ranged(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """`df` in range partitions of `order`, numbered in __part. The bounds are sampled: the numbers are written down once,
    where a lost executor can't lose them."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), tag)


def ordered_prefix_sum(df: DataFrame, keys: list[str], size: Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Running total in key order, of each group of `by` if given, without a window over a whole table or group: range
    partitions, local windows, and what a group brings into a partition that it continues in. A partition continues
    one group at most, so the table of these has at most a row per partition and is broadcast."""
    ranged = _ranged(df.withColumn("__size", size.cast("long")), [*by, *keys], "ranged")
    totals = ranged.groupBy("__part", *by).agg(F.sum("__size").alias("__t"))
    earlier = Window.partitionBy(*by).orderBy("__part")
    brought = totals.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__by_{c}") for c in by), F.sum("__t").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.lag("__part").over(earlier).alias("__prior"))
    brought = brought.where("__prior is not null").drop("__prior")
    on = F.col("__part") == F.col("__p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    local = F.sum("__size").over(Window.partitionBy("__part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    total = local + F.coalesce("__before", F.lit(0).cast("long"))
    return ranged.join(F.broadcast(brought), on, "left").withColumn(out, total).drop("__size", "__before", "__part", "__p", *(f"__by_{c}" for c in by))


def last_known(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """The last value that is not null, of the row itself or of one before it in `order`: range partitions, local
    windows, and what each partition starts with (a row a partition, broadcast)."""
    ranged = _ranged(df.withColumn(out, value), order, "carried")
    ends = ranged.where(F.col(out).isNotNull()).groupBy("__part").agg(F.max_by(out, F.struct(*order)).alias("__end"))
    parts = df.sparkSession.range(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).select(F.col("id").cast("int").alias("__part"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.join(ends, "__part", "left").select("__part", F.last("__end", ignorenulls=True).over(upto).alias("__start"))
    local = F.last(out, ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(starts), "__part").withColumn(out, F.coalesce(local, F.col("__start"))).drop("__part", "__start")
