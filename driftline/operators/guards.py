"""Schemas over time, suspensions, garbage collection, tenancy, audits, preflight, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.model import INTERNAL_TABLES
from driftline.sources.tables import ordered_prefix_sum

# --- schemas -----------------------------------------------------------------------------------------------------


def latest_schemas(log: DataFrame) -> DataFrame:
    """Latest schema per table; a drop leaves a tombstone row."""
    return log.groupBy("table").agg(F.max_by(F.struct("id", "schema", "dropped"), "id").alias("s")).select("table", "s.*")


def changed_schemas(log: DataFrame) -> DataFrame:
    """Rows of the DDL log whose schema differs from the table's previous row."""
    before = F.lag(F.struct("schema")).over(Window.partitionBy("table").orderBy("id"))
    return log.withColumn("__was", before).where(F.col("__was").isNull() | ~F.col("schema").eqNullSafe(F.col("__was.schema"))).drop("__was")


def column_diff(old: Column, new: Column) -> dict[str, Column]:
    return {"added": F.array_sort(F.array_except(new, old)), "removed": F.array_sort(F.array_except(old, new)), "common": F.array_sort(F.array_intersect(old, new))}


def columns_json(layout: DataFrame) -> DataFrame:
    """One document per table: columns in order, key columns in key order."""
    cols = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "type"))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))))
    pk = F.transform(F.array_sort(F.collect_list(F.when(F.col("pk_ordinal").isNotNull(), F.struct("pk_ordinal", "name")))), lambda x: x["name"])
    return layout.groupBy("table").agg(cols.alias("columns"), F.array_join(pk, ",").alias("pk_columns"))


def suspended(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events inside [suspend_lsn, resume_lsn) of their table are lost. Intervals may be many and may overlap: their ends
    are sorted in among the events, before those at the same position, and an event is kept where as many have closed
    as have opened. No event is compared with an interval; those without table or position are in none."""
    ends = F.array(F.struct(F.col("suspend_lsn").alias("lsn"), F.lit(1).alias("__step")), F.struct(F.col("resume_lsn").alias("lsn"), F.lit(-1).alias("__step")))
    marks = intervals.where("resume_lsn is null or suspend_lsn < resume_lsn").select("table", F.inline(ends))
    placed = F.col("table").isNotNull() & F.col("lsn").isNotNull()
    rows = events.where(placed).withColumn("__step", F.lit(0)).unionByName(marks.where(placed), allowMissingColumns=True)
    rows = rows.withColumn("__event", F.col("__step") == 0)
    counted = ordered_prefix_sum(rows, ["lsn", "__event"], F.col("__step"), "__open", by=("table",))
    return counted.where("__event and __open = 0").select(*events.columns).union(events.where(~placed))


def suspensions(ddl: DataFrame) -> DataFrame:
    """(table, lsn, ok) log -> intervals: a bad change suspends, the next good one resumes."""
    w = Window.partitionBy("table").orderBy("lsn")
    turned = ddl.withColumn("was", F.lag("ok").over(w)).where(~F.col("ok").eqNullSafe(F.coalesce("was", F.lit(True))))
    return turned.withColumn("resume_lsn", F.lead("lsn").over(w)).where(~F.col("ok")).select("table", F.col("lsn").alias("suspend_lsn"), "resume_lsn")


# --- garbage collection ------------------------------------------------------------------------------------------


def expired(rows: DataFrame, tombstone: str, now: Column, threshold_s: int) -> DataFrame:
    return rows.where(F.col(tombstone).isNotNull() & (F.col(tombstone) < now - F.make_dt_interval(secs=F.lit(threshold_s))))


def watermark(rows: DataFrame, tombstone: str, now: Column, threshold_s: int) -> DataFrame:
    """The published row: all tombstones before `watermark` are gone."""
    reaped = expired(rows, tombstone, now, threshold_s).agg(F.count("*").alias("reaped"))
    return reaped.select(F.lit(1).alias("id"), (now - F.make_dt_interval(secs=F.lit(threshold_s))).alias("watermark"), F.lit(threshold_s * 1000).cast("long").alias("threshold_ms"), now.alias("swept_at"), "reaped")


def too_old(writes: DataFrame, mark: Column, swept_at: Column, now: Column, stale_s: int) -> DataFrame:
    """Queued writes older than the watermark, or held while the sweep itself is stale, cannot be judged."""
    return writes.withColumn("judgeable", (F.col("version") >= mark) & (swept_at >= now - F.make_dt_interval(secs=F.lit(stale_s))))


def unreaped_tenants(rows: DataFrame, sweeper_tenants: DataFrame, tombstone: str) -> DataFrame:
    """Tenants that hold tombstones and that the sweeper may not see."""
    return rows.where(F.col(tombstone).isNotNull()).select("tenant").distinct().join(sweeper_tenants.select("tenant"), "tenant", "left_anti")


# --- tenancy -----------------------------------------------------------------------------------------------------


def readable(rows: DataFrame, tenant: str | None) -> DataFrame:
    """Reading: everything without a tenant set, else the tenant's rows."""
    return rows if tenant is None else rows.where(F.col("tenant") == tenant)


def writable(writes: DataFrame, grants: DataFrame, open_tenant: str) -> DataFrame:
    """Writing: rows of the principal's tenants, and of the open one."""
    mine = writes.join(grants.select("principal", "tenant"), ["principal", "tenant"], "left_semi")
    return mine.unionByName(writes.join(grants.select("principal", "tenant"), ["principal", "tenant"], "left_anti").where(F.col("tenant") == open_tenant))


def filled(writes: DataFrame, grants: DataFrame) -> DataFrame:
    """An empty tenant becomes the principal's; none, or one that can be no token, is an error."""
    own = grants.groupBy("principal").agg(F.min("tenant").alias("own"))
    tenant = F.coalesce(F.nullif(F.col("tenant"), F.lit("")), F.col("own"))
    joined = writes.join(own, "principal", "left").withColumn("tenant", tenant).drop("own")
    return joined.withColumn("error", F.when(F.col("tenant").isNull(), "no_tenant").when(~S.token_valid(F.col("tenant")), "bad_tenant"))


#: Verdicts of the publication audit.
AUDIT = {
    "internal": "internal — expected",
    "pass_through": "PASS-THROUGH — every row reaches every subscriber of this publication",
    "cdc_unscoped": "CDC UNSCOPED — RLS bounds the snapshot, pgoutput ignores it",
    "writes_unscoped": "reads scoped, WRITES UNSCOPED — no policy bounds what a principal may write",
    "scoped": "scoped",
}


def publication_audit(published: DataFrame) -> DataFrame:
    """(publication, table, row_filter, rls) -> with verdict: is anything published without being scoped?"""
    filtered, rls = F.col("row_filter").isNotNull(), F.col("rls")
    verdict = (
        F.when(F.col("table").endswith("ddl_events"), AUDIT["internal"]).when(~filtered & ~rls, AUDIT["pass_through"])
        .when(~filtered, AUDIT["cdc_unscoped"]).when(~rls, AUDIT["writes_unscoped"]).otherwise(AUDIT["scoped"])
    )
    return published.withColumns({"row_filter": F.coalesce("row_filter", F.lit("(none)")), "verdict": verdict})


def unscoped(added: DataFrame, public_tables: DataFrame) -> DataFrame:
    """Of the tables that a publication change adds, those it must refuse: no row filter, no row security, neither internal
    nor recorded as public. Only tables of this change are judged."""
    internal = F.col("table").endswith("ddl_events") | F.col("table").endswith("principal_tenants")
    open_ = added.where(~internal & F.col("row_filter").isNull() & ~F.col("rls"))
    return open_.join(public_tables.select("table"), "table", "left_anti")


def publication_guard(added: DataFrame, public_tables: DataFrame) -> DataFrame:
    """`added`, or an error that names a table which would be published unscoped."""
    first = unscoped(added, public_tables).select("table").take(1)
    if first:
        raise PreflightError(f"refusing to publish {first[0][0]} unscoped: no row filter and no row security")
    return added


def guard_audit(tables: DataFrame, triggers: DataFrame) -> DataFrame:
    """Tables (table) and their triggers (table, name, definition) -> table, version_guard, delete_guard, detail: the
    definitions of guards in the order of their names. Internal tables are left out."""
    guards = triggers.where(F.col("name").isin(*GUARDS)).groupBy("table").agg(F.array_sort(F.collect_set(F.struct("name", "definition"))).alias("own"))
    has = lambda name: F.coalesce(F.exists("own", lambda g: g["name"] == name), F.lit(False))
    joined = tables.where(~F.col("table").isin(*INTERNAL_TABLES)).join(guards, "table", "left")
    return joined.select("table", has(GUARDS[0]).alias("version_guard"), has(GUARDS[1]).alias("delete_guard"), F.coalesce(F.array_join(F.transform("own", lambda g: g["definition"]), " | "), F.lit("")).alias("detail"))


#: Names of the triggers that guard versions and deletes.
GUARDS = ("bump_version", "soft_delete")


def plan_of(requests: DataFrame) -> DataFrame:
    """Steps of enabling tables -> (table, ordinal, step, status).

    requests: table, tenant_col, tenant_col_known, writable, write_half (is it installed), version_col, tombstone_col,
    public_reason, rls, row_filter, is_public, published, columns (array), dry_run. What can't go ahead is one ERROR row;
    else writes, guards and row security come before the publication, which refuses what isn't scoped, and what lies
    outside the database is MANUAL."""
    c = F.col
    tenant, verb = c("tenant_col").isNotNull(), F.when(c("dry_run"), "would").otherwise("done")
    scoped = c("rls") | c("row_filter").isNotNull() | c("is_public") | c("public_reason").isNotNull() | (c("writable") & tenant)
    error = (c("writable") & ~c("write_half")) | (tenant & ~c("tenant_col_known")) | ~scoped
    steps = [
        ("grants", verb, c("writable")),
        ("guards", F.when(c("version_col").isNull(), "skipped").otherwise(verb), c("writable")),
        ("rls", verb, tenant),
        ("public", verb, c("public_reason").isNotNull()),
        ("publication", F.when(c("published"), "already").otherwise(verb), F.lit(True)),
        ("publication", F.lit("NOTE"), c("columns").isNotNull() & tenant),
        ("T3 bridge env", F.lit("MANUAL"), tenant),
        ("T3 bridge env", F.lit("MANUAL"), c("writable") & c("version_col").isNotNull()),
        ("T4 nats conf", F.lit("MANUAL"), F.lit(True)),
        ("summary", F.lit("DRY RUN"), c("dry_run")),
    ]
    row = lambda step, status, when: F.when(when, F.struct(F.lit(step).alias("step"), status.alias("status")))
    every = F.filter(F.array(*(row(*s) for s in steps)), lambda s: s.isNotNull())
    failed = F.array(F.struct(F.lit("preflight").alias("step"), F.lit("ERROR").alias("status")))
    return requests.select("table", F.posexplode(F.when(error, failed).otherwise(every)).alias("ordinal", "s")).select("table", "ordinal", "s.step", "s.status")


# --- preflight and metrics ---------------------------------------------------------------------------------------


def findings(tables: DataFrame) -> DataFrame:
    """tables: pk_columns (their number), identity (d, f, n, i), has_rules. Without a key the source itself refuses
    updates, unless the identity is the whole row or an index."""
    no_key, identity = F.col("pk_columns") == 0, F.col("identity")
    return tables.withColumns({"refused_no_pk": no_key, "writes_rejected": no_key & identity.isin("d", "n"), "transitions_inert": F.col("has_rules") & (identity != "f")})


def preflight_summary(found: DataFrame) -> DataFrame:
    any_one = F.col("refused_no_pk") | F.col("writes_rejected") | F.col("transitions_inert")
    return found.agg(F.count("*").alias("checked"), F.count_if(any_one).alias("with_findings"), F.count_if("refused_no_pk").alias("refused"))


class PreflightError(RuntimeError):
    pass


def strict(found: DataFrame) -> None:
    """Strict mode refuses to start on any refusal."""
    if found.where("refused_no_pk").take(1):
        raise PreflightError("tables without a primary key are published")


def lag_level(lag: Column) -> Column:
    return F.when(lag >= 1 << 30, "critical").when(lag >= 512 << 20, "warning").otherwise("ok")


def rates(events: DataFrame, ts: str) -> DataFrame:
    """Events a minute."""
    return events.groupBy(F.window(ts, "1 minute").alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("minute"), "events")


def max_columns(layout: DataFrame) -> DataFrame:
    """Widest table's column count, rounded up to 8 and kept in 8..1600."""
    per = layout.groupBy("table").agg(F.count("*").alias("n"))
    return per.agg(F.max("n").alias("widest")).withColumn("slots", S.clamped(S.ceil_to(F.col("widest"), 8), 8, 1600).cast("long"))
