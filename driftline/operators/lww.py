"""Last-write-wins merges, verdicts, write guards, retries, outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.model import INTERNAL_TABLES, MAX_DELIVER, TableSpec


def wins(stored_version: Column, stored_client: Column, version: Column, client: Column | None) -> Column:
    """The guard: no stored version, an older one, or the same one by a lesser client (only with a client column)."""
    older = stored_version.isNull() | (stored_version < version)
    if client is None:
        return F.coalesce(older, F.lit(False))
    tie = (stored_version == version) & (F.coalesce(stored_client, F.lit("")) < F.coalesce(client, F.lit("")))
    return F.coalesce(older | tie, F.lit(False))


def merged_upserts(writes: DataFrame, key: list[str], version: str, client: str) -> DataFrame:
    """State after upserts, whatever their order: the write of greatest (version, client), the earliest of equals.
    Map-side combined, so a hot key costs a row per task."""
    rest = [c for c in writes.columns if c not in key]
    best = writes.where(F.col(version).isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.coalesce(client, F.lit("")), -F.col("seq"))).alias("s"))
    return best.select(*key, *(F.col(f"s.{c}").alias(c) for c in rest))


def upsert_verdicts(writes: DataFrame, key: list[str], version: str, client: str) -> DataFrame:
    """Verdicts of upserts in arrival order: accepted if greater than everything before (a streaming window, no lists)."""
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.struct(F.col(version), F.coalesce(client, F.lit("")))
    before = F.max(F.when(F.col(version).isNotNull(), mine)).over(w)
    first = F.lag("seq").over(Window.partitionBy(*key).orderBy("seq")).isNull()
    return writes.withColumn("status", F.when(first | before.isNull() | (before < mine), "accepted").otherwise("rejected")).withColumn("reason", F.when(F.col("status") == "rejected", "stale"))


def folded(writes: DataFrame, key: list[str], spec: TableSpec, state: DataFrame | None = None) -> DataFrame:
    """Ordered fold of insert, update and delete per key -> (key, state, verdicts).

    writes: key columns, seq, operation, version, client, data map. A delete stamps version and tombstone but no
    client, and has no tie arm; without a tombstone column it removes the row. An update never inserts.
    Upserts and updates set only the columns they carry, and revive a tombstoned row.
    The fold is exact for any mix; a key's own writes are one list (upserts alone need `upsert_verdicts`)."""
    with_client = spec.client is not None
    kind = dict(writes.dtypes)["version"]
    start = f"struct<present:boolean,version:{kind},client:string,tombstone:{kind},data:map<string,string>,verdicts:array<struct<seq:bigint,status:string,reason:string>>>"
    empty = F.struct(F.lit(False).alias("present"), F.lit(None).cast(kind).alias("version"), F.lit(None).cast("string").alias("client"), F.lit(None).cast(kind).alias("tombstone"), F.create_map().cast("map<string,string>").alias("data"), F.array().cast("array<struct<seq:bigint,status:string,reason:string>>").alias("verdicts")).cast(start)

    def step(a: Column, m: Column) -> Column:
        delete, update = m["operation"] == "DELETE", m["operation"] == "UPDATE"
        guard = wins(a["version"], a["client"], m["version"], m["client"] if with_client else None)
        guard = F.when(delete, wins(a["version"], a["client"], m["version"], None)).otherwise(guard)
        ok = F.when(a["present"], guard).otherwise(~delete & ~update)
        gone = ok & delete & F.lit(spec.tombstone is None)
        dead = ok & delete & F.lit(spec.tombstone is not None)
        write = ok & ~delete
        overlaid = F.map_concat(F.map_filter(a["data"], lambda k, _: ~F.array_contains(F.map_keys(m["data"]), k)), m["data"])
        reason = F.when(~ok, F.when(~a["present"] | a["tombstone"].isNotNull(), "row_deleted").otherwise("stale"))
        return F.struct(
            F.when(gone, False).when(write, True).otherwise(a["present"]).alias("present"),
            F.when(gone, None).when(ok, m["version"]).otherwise(a["version"]).alias("version"),
            F.when(gone, None).when(write, m["client"]).otherwise(a["client"]).alias("client"),
            F.when(dead, m["version"]).when(gone | write, None).otherwise(a["tombstone"]).alias("tombstone"),
            F.when(gone, F.create_map().cast("map<string,string>")).when(write, F.when(a["present"], overlaid).otherwise(m["data"])).otherwise(a["data"]).alias("data"),
            F.concat(a["verdicts"], F.array(F.struct(m["seq"].cast("bigint").alias("seq"), F.when(ok, "accepted").otherwise("rejected").alias("status"), reason.alias("reason")))).alias("verdicts"),
        ).cast(start)

    ordered = writes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "operation", "version", "client", "data")), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("writes"))
    if state is not None:
        ordered = ordered.join(state.withColumnRenamed("state", "__from"), key, "full_outer")
        empty = F.coalesce(F.col("__from"), empty)
    done = ordered.withColumn("state", F.aggregate(F.coalesce("writes", F.array().cast(dict(ordered.dtypes)["writes"])), empty, step))
    return done.select(*key, "state")


def fold_verdicts(done: DataFrame, key: list[str]) -> DataFrame:
    return done.select(*key, F.explode("state.verdicts").alias("v")).select(*key, "v.seq", "v.status", "v.reason")


def clamped(writes: DataFrame, version: str, arrived: str) -> DataFrame:
    """Versions ahead of the arrival clock are cut back; `clamped` says so."""
    cut = S.clamp_version(F.col(version), F.col(arrived))
    return writes.withColumn("clamped", ~cut.eqNullSafe(F.col(version))).withColumn(version, cut)


def checked(writes: DataFrame, spec: TableSpec, buffer_bytes: int = 1 << 14) -> DataFrame:
    """`error` of each mutation, null if it may be applied. Version and client come from the envelope only."""
    allowed = F.array(*(F.lit(c) for c in spec.columns))
    keys = F.array(*(F.lit(c) for c in spec.pk))
    unknown = F.size(F.array_except(F.map_keys("data"), allowed)) > 0
    envelope = F.arrays_overlap(F.map_keys("data"), F.array(*(F.lit(c) for c in (spec.version, spec.client) if c)))
    reassigned = (F.upper("operation") == "UPDATE") & F.arrays_overlap(F.map_keys("data"), keys)
    whole = F.forall(keys, lambda k: F.element_at(F.col("key"), k).isNotNull())
    error = (
        F.when(F.col("table").isin(*INTERNAL_TABLES), "ForbiddenTable").when(F.col("bytes") >= buffer_bytes, "RowTooLargeToReplicate")
        .when(~whole, "MissingPrimaryKey").when(unknown | envelope, "UnknownColumn").when(reassigned, "PrimaryKeyReassigned")
    )
    return writes.withColumn("error", error)


def retried(failures: DataFrame) -> DataFrame:
    """Permanent errors, operator faults among them, are rejected and dead-lettered at once; others come again until
    their last delivery."""
    permanent = S.sqlstate_permanent(F.col("sqlstate")) | S.error_permanent(F.col("error"))
    return failures.withColumn("action", F.when(permanent, "reject").when(F.col("delivered") >= MAX_DELIVER, "fail").otherwise("retry"))


def dead_letters(failures: DataFrame) -> DataFrame:
    return retried(failures).where("action = 'reject'").select(F.concat(F.lit("mutation_error."), F.col("table")).alias("subject"), S.error_text(F.col("error")).alias("error"), "bytes")


def verdicts(applied: DataFrame) -> DataFrame:
    """Verdict messages; without a valid message id there is none."""
    return applied.where(S.token_valid(F.col("msg_id"))).withColumn("subject", F.concat_ws(".", F.lit("mutation_ack"), F.col("principal"), F.col("msg_id")))


def outcome(affected: Column, present: Column, tombstone: Column) -> Column:
    return F.when(affected > 0, "accepted").when(~present | tombstone.isNotNull(), "row_deleted").otherwise("stale")


def soft_deletes(writes: DataFrame, sweeper: str) -> DataFrame:
    """A DELETE by anyone but the sweeper becomes an UPDATE of tombstone and version."""
    soft = (F.col("operation") == "DELETE") & ~F.col("principal").eqNullSafe(F.lit(sweeper))
    return writes.withColumns({"tombstone": F.when(soft, F.col("arrived")), "version": F.when(soft, F.col("arrived")).otherwise(F.col("version")), "operation": F.when(soft, "UPDATE").otherwise(F.col("operation"))})


def bumped(writes: DataFrame, old: str, new: str, now: Column) -> DataFrame:
    """A writer that left the version as it was gets the clock."""
    return writes.withColumn(new, F.when(F.col(old).eqNullSafe(F.col(new)), now).otherwise(F.col(new)))


def outbox(log: DataFrame) -> DataFrame:
    """(msg_id, action put or drop, seq, ...) -> outstanding messages with their attempts, oldest first."""
    puts = log.groupBy("msg_id").agg(F.max_by("action", "seq").alias("last"), (F.count_if(F.col("action") == "put") - 1).alias("attempts"), F.min("created_at").alias("created_at"))
    return puts.where("last = 'put'").drop("last")


def outstanding(pending: DataFrame, answered: DataFrame) -> DataFrame:
    """Pending writes without echo or verdict."""
    return pending.join(answered.select("msg_id").distinct(), "msg_id", "left_anti")
