"""Change events: normalising, routing, refusing, transactions, transitions, dedupe, batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import scalars as S
from driftline.model import BATCH_BYTES, BATCH_EVENTS, BATCH_MS, INTERNAL_TABLES
from driftline.sources.tables import ordered_prefix_sum


def normalised(rows: DataFrame, ordinal: Column | None = None) -> DataFrame:
    """(lsn, table, operation[, tenant]) rows get subject and msg_id; the payload's operation is upper case."""
    tenant = F.col("tenant") if "tenant" in rows.columns else None
    return rows.withColumns({"operation": F.upper("operation"), "subject": S.subject_of(F.col("table"), F.col("operation"), tenant), "msg_id": S.message_id(F.col("lsn"), F.col("table"), F.col("operation"), ordinal)})


def routed(rows: DataFrame, value: Column) -> DataFrame:
    """Tenant from a row value, `unrouted` if it can be no subject token."""
    return rows.withColumn("tenant", F.when(S.token_valid(value), value).otherwise("unrouted"))


def with_relation(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """Table of each row by relation id; rows of unknown relations are skipped."""
    return rows.join(relations.select("relation_id", "table"), "relation_id")


def monitored(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of monitored tables: equal names, or schema-qualified ones that end in .table."""
    bare = names.select(F.element_at(F.split("monitored", r"\."), -1).alias("table"), "monitored")
    hit = bare.where((F.col("monitored") == F.col("table")) | F.col("monitored").endswith(F.concat(F.lit("."), F.col("table"))))
    return rows.join(hit.select("table").distinct(), "table", "left_semi")


def without_internal(rows: DataFrame, internal=INTERNAL_TABLES) -> DataFrame:
    """Bookkeeping tables go, whatever the operation."""
    return rows.where(~F.col("table").isin(*internal))


def without_refused(rows: DataFrame, refusals: DataFrame) -> DataFrame:
    return rows.join(refusals.where("active").select("table"), "table", "left_anti")


def refused_counts(rows: DataFrame, refusals: DataFrame) -> DataFrame:
    """Dropped rows per refused table."""
    return rows.join(refusals.where("active").select("table", "reason"), "table").groupBy("table", "reason").agg(F.count("*").alias("dropped"))


def without_reaps(rows: DataFrame, tombstoned_tables: list[str]) -> DataFrame:
    """Physical deletes of tables with a tombstone column are the sweeper's and aren't published."""
    return rows.where(~((F.col("operation") == "DELETE") & F.col("table").isin(*tombstoned_tables)))


def committed(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of transactions that have a commit."""
    return rows.join(commits.select("xid").distinct(), "xid", "left_semi")


def transitions(rows: DataFrame, key: str, order: str, watched: list[str]) -> DataFrame:
    """UPDATEs classed as transition (a watched column differs from the row before) or data. A value that is
    unchanged counts as equal; with no earlier row there is no transition."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.lit(False)
    for c in watched:
        before = F.lag(F.struct(c)).over(w)
        changed = changed | (before.isNotNull() & ~F.col(c).eqNullSafe(before.getField(c)))
    return rows.withColumn("class", F.when(F.col("operation") == "UPDATE", F.when(changed, "transition").otherwise("data")))


def transitions_of_pairs(rows: DataFrame, watched: list[str]) -> DataFrame:
    """The same from old and new maps; columns listed as unchanged are equal."""
    changed = F.lit(False)
    for c in watched:
        differs = F.map_contains_key("data", c) & ~F.array_contains("unchanged", c) & ~F.element_at("old", c).eqNullSafe(F.element_at("data", c))
        changed = changed | (F.map_contains_key("old", c) & differs)
    return rows.withColumn("class", F.when(F.col("operation") == "UPDATE", F.when(F.coalesce(changed, F.lit(False)), "transition").otherwise("data")))


def plain(column: pa.Array) -> list:
    """The column as Python values; whole numbers without nulls take the short way."""
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def first_in_window(rows: DataFrame, key: list[str], at: str, window_s: int, out: str) -> DataFrame:
    """`rows` with a boolean: the first row of each window of its key. A window counts from the last row that was
    first; rows in it don't renew it. Rows stream through in the order of key, time and seq, with one time held."""
    slim = rows.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__key", F.to_json(F.struct(*key)))

    def run(batches):
        last, counted = None, None
        for batch in batches:
            keep = []
            for name, now in zip(plain(batch.column("__key")), plain(batch.column("__at")), strict=True):
                new = counted is None or name != last
                keep.append(new or now is None or counted[0] is None or now - counted[0] > window_s * 1_000_000)
                if keep[-1]:
                    last, counted = name, (now,)
            yield batch.append_column(out, pa.array(keep, pa.bool_()))

    ordered = slim.repartition("__key").sortWithinPartitions("__key", "__at", "seq")
    return ordered.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField(out, T.BooleanType())])).drop("__at", "__key")


def deduplicated(rows: DataFrame, window_s: int = 120) -> DataFrame:
    """A message id counts once in a window after its last appearance that counted: copies in between don't renew it."""
    return first_in_window(rows, ["msg_id"], "arrived", window_s, "__first").where("__first").drop("__first")


def batches(rows: DataFrame, size: int = BATCH_EVENTS) -> DataFrame:
    """One message per batch and subject: rows in log order, subjects in the order of first appearance."""
    grouped = rows.withColumn("batch", F.floor((F.col("seq") - 1) / size)).groupBy("batch", "subject")
    out = grouped.agg(F.count("*").alias("events"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))
    return out.withColumn("batch_msg_id", F.format_string("batch-%s-to-%s", F.lower(F.hex("first_lsn")), F.lower(F.hex("last_lsn"))))


def batch_bodies(rows: DataFrame, body: str, size: int = BATCH_EVENTS) -> DataFrame:
    """The messages themselves; a batch has at most `size` rows, so its list is bounded."""
    grouped = rows.withColumn("batch", F.floor((F.col("seq") - 1) / size)).groupBy("batch", "subject")
    return grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("lsn", "seq", body))), lambda x: x[body]).alias("events"))


def triggered(rows: DataFrame, size: str, at: str, events: int = BATCH_EVENTS, size_limit: int = BATCH_BYTES, wait_ms: int = BATCH_MS) -> DataFrame:
    """`rows` (xid, seq, ...) with `batch`, its number in the transaction. A commit ends a batch, so none crosses
    transactions; within one a batch is full at `events` rows, at `size_limit` bytes (looked at before a row is added, so the
    last row may go over) or `wait_ms` after its first row. Null sizes count 0, a null time ends nothing.

    A transaction's rows stream through one task in log order with three numbers held, however many they are."""
    slim = rows.withColumns({"__size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "__at": F.unix_millis(F.col(at).cast("timestamp"))})

    def run(batches):
        xid, batch, count, used, since = None, None, 0, 0, None
        for part in batches:
            out = []
            for x, n, now in zip(*(plain(part.column(c)) for c in ("xid", "__size", "__at")), strict=True):
                late = since is not None and now is not None and now - since >= wait_ms
                if batch is None or x != xid:
                    xid, batch, count, used, since = x, 0, 0, 0, now
                elif count >= events or used >= size_limit or late:
                    batch, count, used, since = batch + 1, 0, 0, now
                count, used = count + 1, used + n
                out.append(batch)
            yield part.append_column("batch", pa.array(out, pa.int64()))

    ordered = slim.repartition("xid").sortWithinPartitions("xid", "seq")
    return ordered.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("batch", T.LongType())])).drop("__size", "__at")


def schema_runs(rows: DataFrame) -> DataFrame:
    """Schema messages split the run: `run` grows at each, so that schemas precede the rows that follow them."""
    return ordered_prefix_sum(rows, ["seq"], F.col("is_schema").cast("int"), "run", by=("table",))


def gaps(seen: DataFrame, streams: DataFrame) -> DataFrame:
    """Per stream: a gap if nothing was seen, or the next row wanted is older than the first one retained."""
    joined = streams.join(seen, "stream", "left").withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
    return joined.withColumn("gap", (F.col("seq") == 0) | ((F.col("first_seq") > 0) & (F.col("seq") < F.col("first_seq") - 1)))


def display_verb(operation: Column, tombstone: Column) -> Column:
    verbs = F.when(operation == "INSERT", "INS").when(operation == "UPDATE", "UP").otherwise("DEL")
    return F.when(tombstone.isNotNull(), "DEL").otherwise(verbs)


def streams_for(principals: DataFrame) -> DataFrame:
    """Principals with a tenant read their own and the public stream, others the public one."""
    both = F.when(F.col("tenant").isNotNull(), F.array(F.col("tenant"), F.lit("public"))).otherwise(F.array(F.lit("public")))
    return principals.withColumn("stream", F.explode(both))


def debounced(requests: DataFrame, window_s: int = 60) -> DataFrame:
    """Of requests per (tenant, table) one passes, and the next one more than `window_s` after it; requests that are
    turned away in between don't extend the window."""
    return first_in_window(requests, ["tenant", "table"], "ts", window_s, "accepted")
