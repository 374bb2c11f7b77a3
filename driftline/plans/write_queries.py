"""Queries over the write path, tenancy, garbage collection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.model import TableSpec
from driftline.operators import guards as G
from driftline.operators import lww as L
from driftline.operators import replica as R
from driftline.plans.base import CHANGES, changes, values
from driftline.plans.registry import query
from driftline.sources import tables as T

W = f"WITH {CHANGES} "
NOW = datetime(2024, 6, 1)


@query(W + """SELECT pk, seq, version, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY version DESC, event_type DESC, seq) AS r FROM changes) WHERE r = 1""")
def lww_merge(spark, d):
    rows = changes(spark, d).select("pk", "seq", "version", "event_type", "value")
    return L.merged_upserts(rows, ["pk"], "version", "event_type")


@query(W + """SELECT seq, CASE WHEN before IS NULL OR before < mine THEN 'accepted' ELSE 'rejected' END AS status FROM (SELECT seq, strftime(version, '%Y%m%d%H') || event_type AS mine, max(strftime(version, '%Y%m%d%H') || event_type) OVER (PARTITION BY pk ORDER BY shuffled ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, (seq * 7919) % 1000003 AS shuffled FROM changes))""")
def lww_verdicts(spark, d):
    rows = changes(spark, d).withColumns({"own": F.col("seq"), "seq": F.col("seq") * 7919 % 1000003})
    return L.upsert_verdicts(rows, ["pk"], "version", "event_type").select(F.col("own").alias("seq"), "status")


USERS = TableSpec("users", ("pk",), ("pk", "kind"), "version", client="client", tombstone="deleted_at")

_FOLD = f"""WITH RECURSIVE {CHANGES}, w AS (SELECT pk, seq, operation, version, event_type AS client, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n FROM changes),
 f AS (SELECT pk, 0::BIGINT AS n, false AS present, NULL::TIMESTAMP AS version, NULL::VARCHAR AS client, NULL::TIMESTAMP AS tomb, NULL::VARCHAR AS kind, NULL::BIGINT AS seq, NULL::VARCHAR AS status, NULL::VARCHAR AS reason FROM (SELECT DISTINCT pk FROM w)
 UNION ALL SELECT pk, n, CASE WHEN ok AND op <> 'DELETE' THEN true ELSE present END, CASE WHEN ok THEN mv ELSE version END, CASE WHEN ok AND op <> 'DELETE' THEN mc ELSE client END,
  CASE WHEN ok AND op = 'DELETE' THEN mv WHEN ok THEN NULL ELSE tomb END, CASE WHEN ok AND op <> 'DELETE' THEN mc ELSE kind END, mseq, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END,
  CASE WHEN ok THEN NULL WHEN NOT present OR tomb IS NOT NULL THEN 'row_deleted' ELSE 'stale' END
 FROM (SELECT f.*  EXCLUDE (n, seq, status, reason), w.n, w.operation AS op, w.version AS mv, w.client AS mc, w.seq AS mseq,
  CASE WHEN f.present THEN (f.version IS NULL OR f.version < w.version OR (w.operation <> 'DELETE' AND f.version = w.version AND coalesce(f.client, '') < w.client)) ELSE w.operation = 'INSERT' END AS ok
  FROM f JOIN w ON f.pk = w.pk AND w.n = f.n + 1)) """


def _folded(spark, d):
    rows = changes(spark, d).select("pk", "seq", "operation", "version", F.col("event_type").alias("client"), F.create_map(F.lit("kind"), F.col("event_type")).alias("data"))
    return L.folded(rows, ["pk"], USERS)


@query(_FOLD + "SELECT pk, seq, status, reason FROM f WHERE n > 0")
def lww_fold_verdicts(spark, d):
    return L.fold_verdicts(_folded(spark, d), ["pk"])


@query(_FOLD + "SELECT pk, present, version, client, tomb AS tombstone, kind FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY n DESC) AS r FROM f) WHERE r = 1")
def lww_fold_state(spark, d):
    return _folded(spark, d).select("pk", "state.present", "state.version", "state.client", "state.tombstone", F.element_at("state.data", "kind").alias("kind"))


@query(W + """SELECT seq, least(v, ts + INTERVAL 5 SECOND) AS v, v > ts + INTERVAL 5 SECOND AS clamped FROM (SELECT seq, ts, ts + to_seconds(seq % 12) AS v FROM changes)""")
def version_clamp(spark, d):
    rows = changes(spark, d).select("seq", "ts", (F.col("ts") + F.make_dt_interval(secs=F.col("seq") % 12)).alias("v"))
    return L.clamped(rows, "v", "ts").select("seq", "v", "clamped")


@query(W + """SELECT seq, CASE WHEN operation = 'DELETE' AND pk % 5 <> 0 THEN 'UPDATE' ELSE operation END AS operation, CASE WHEN operation = 'DELETE' AND pk % 5 <> 0 THEN ts END AS tombstone, CASE WHEN operation = 'DELETE' AND pk % 5 <> 0 THEN ts ELSE version END AS version FROM changes""")
def soft_delete(spark, d):
    rows = changes(spark, d).withColumns({"principal": F.when(F.col("pk") % 5 == 0, "sweeper").otherwise("app"), "arrived": F.col("ts")})
    return L.soft_deletes(rows, "sweeper").select("seq", "operation", "tombstone", "version")


@query(W + """SELECT seq, CASE WHEN seq % 3 = 0 THEN TIMESTAMP '2024-06-01' ELSE version END AS version FROM changes""")
def version_bump(spark, d):
    rows = changes(spark, d).withColumn("was", F.when(F.col("seq") % 3 == 0, F.col("version")))
    return L.bumped(rows, "was", "version", F.lit(NOW).cast("timestamp_ntz")).select("seq", "version")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'ForbiddenTable' WHEN o_orderkey % 7 = 0 THEN 'RowTooLargeToReplicate' WHEN o_orderkey % 5 = 0 THEN 'MissingPrimaryKey' WHEN o_orderkey % 3 = 0 THEN 'UnknownColumn' WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'PrimaryKeyReassigned' END AS error FROM orders""")
def write_guards(spark, d):
    k = F.col("o_orderkey")
    o = T.scan(spark, d, "orders").select(
        k, F.when(k % 11 == 0, "gc_watermark").otherwise("orders").alias("table"), F.when(k % 7 == 0, 1 << 20).otherwise(100).alias("bytes"),
        F.create_map(F.lit("id"), F.when(k % 5 != 0, k.cast("string"))).alias("key"), F.when(F.col("o_orderstatus") == "O", "update").otherwise("insert").alias("operation"),
        F.when(k % 3 == 0, F.create_map(F.lit("color"), F.lit("red"))).when(k % 2 == 0, F.create_map(F.lit("id"), F.lit("1"))).otherwise(F.create_map(F.lit("status"), F.lit("x"))).alias("data"),
    )
    return L.checked(o, TableSpec("orders", ("id",), ("id", "status"))).select("o_orderkey", "error")


#: Failures and what is to be done with them on the 3rd and on the 15th delivery: the expected outcomes are written out.
_FAILURES = [
    ("42501", "", "reject", "reject"), ("23502", "", "reject", "reject"), ("23503", "", "reject", "reject"), ("23505", "", "reject", "reject"), ("22P02", "", "reject", "reject"), ("42703", "", "reject", "reject"), ("42P01", "", "reject", "reject"), ("0A000", "", "reject", "reject"), ("3F000", "", "reject", "reject"),
    ("57P01", "", "retry", "fail"), ("08006", "", "retry", "fail"), ("08000", "", "retry", "fail"), ("40001", "", "retry", "fail"), ("40P01", "", "retry", "fail"), ("53300", "", "retry", "fail"), ("55P03", "", "retry", "fail"), ("XX000", "", "retry", "fail"), ("99999", "", "retry", "fail"), ("", "", "retry", "fail"), ("4", "", "retry", "fail"),
    ("", "MutationFailed", "retry", "fail"), ("", "MalformedSubject", "reject", "reject"), ("", "UnknownOperation", "reject", "reject"), ("", "MissingVersion", "reject", "reject"), ("", "InvalidPayloadFormat", "reject", "reject"), ("", "MissingPrimaryKey", "reject", "reject"),
    ("", "NoPrimaryKey", "reject", "reject"), ("", "NoVersionColumn", "reject", "reject"), ("", "NoTombstoneColumn", "reject", "reject"), ("", "DbAllocatedKey", "reject", "reject"),
]


def _rows(rows, names):
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


@query(f"SELECT sqlstate, error, n::BIGINT AS delivered, CASE n WHEN 3 THEN early ELSE late END AS action FROM {_rows(_FAILURES, 'sqlstate, error, early, late')}, (VALUES (3), (15)) AS d(n)")
def retry_classification(spark, d):
    rows = values(spark, [(s, e, n) for s, e, _, _ in _FAILURES for n in (3, 15)], "sqlstate string, error string, delivered long")
    return L.retried(rows).select("sqlstate", "error", "delivered", "action")


@query(W + """, box AS (SELECT pk AS msg_id, seq, ts, CASE WHEN event_type IN ('error', 'purchase') THEN 'drop' ELSE 'put' END AS action FROM changes)
 SELECT msg_id, count(*) FILTER (action = 'put') - 1 AS attempts, min(ts) AS created_at FROM box GROUP BY msg_id HAVING arg_max(action, seq) = 'put'""")
def outbox_state(spark, d):
    rows = changes(spark, d).select(F.col("pk").alias("msg_id"), "seq", F.col("ts").alias("created_at"), F.when(F.col("event_type").isin("error", "purchase"), "drop").otherwise("put").alias("action"))
    return L.outbox(rows)


@query(W + "SELECT seq, pk FROM changes WHERE seq NOT IN (SELECT seq FROM changes WHERE event_type = 'click')")
def outbox_outstanding(spark, d):
    c = changes(spark, d).withColumn("msg_id", F.col("seq"))
    return L.outstanding(c, c.where("event_type = 'click'")).select("seq", "pk")


_TOMBS = W + """, rows_ AS (SELECT pk, 't' || (pk % 4) AS tenant, max(ts) FILTER (operation = 'DELETE' AND seq % 7 = 0) AS deleted_at FROM changes GROUP BY pk), clock AS (SELECT max(ts) AS now FROM changes) """


def _tombs(spark, d):
    c = changes(spark, d)
    rows = c.groupBy("pk", "tenant").agg(F.max(F.when((F.col("operation") == "DELETE") & (F.col("seq") % 7 == 0), F.col("ts"))).alias("deleted_at"))
    return rows.crossJoin(F.broadcast(c.agg(F.max("ts").alias("now"))))


@query(_TOMBS + "SELECT pk, deleted_at FROM rows_, clock WHERE deleted_at < now - INTERVAL 3600 SECOND")
def sweep_expired(spark, d):
    return G.expired(_tombs(spark, d), "deleted_at", F.col("now"), 3600).select("pk", "deleted_at")


@query(_TOMBS + "SELECT 1 AS id, TIMESTAMP '2024-06-01' - INTERVAL 3600 SECOND AS watermark, 3600000::BIGINT AS threshold_ms, TIMESTAMP '2024-06-01' AS swept_at, count(*) FILTER (deleted_at < TIMESTAMP '2024-06-01' - INTERVAL 3600 SECOND) AS reaped FROM rows_")
def gc_watermark(spark, d):
    return G.watermark(_tombs(spark, d), "deleted_at", F.lit(NOW).cast("timestamp_ntz"), 3600)


@query(W + "SELECT seq, version >= TIMESTAMP '2024-01-01 12:00:00' AS judgeable FROM changes")
def late_writes(spark, d):
    ntz = lambda *a: F.lit(datetime(*a)).cast("timestamp_ntz")
    return G.too_old(changes(spark, d), ntz(2024, 1, 1, 12), ntz(2024, 6, 1), ntz(2024, 6, 1, 0, 1), 3600).select("seq", "judgeable")


@query(_TOMBS + "SELECT DISTINCT tenant FROM rows_ WHERE deleted_at IS NOT NULL AND tenant NOT IN ('t1', 't2')")
def unreaped_tenants(spark, d):
    return G.unreaped_tenants(_tombs(spark, d), values(spark, [("t1",), ("t2",)], "tenant string"), "deleted_at")


@query(_TOMBS + "SELECT pk, tenant FROM rows_ WHERE deleted_at IS NULL")
def live_rows(spark, d):
    return R.live(_tombs(spark, d), "deleted_at").select("pk", "tenant")


@query(W + "SELECT seq, tenant FROM changes WHERE tenant = 't2'")
def rls_read(spark, d):
    return G.readable(changes(spark, d), "t2").select("seq", "tenant")


def _grants(spark):
    return values(spark, [("alice", "t0"), ("alice", "t1"), ("bob", "t2")], "principal string, tenant string")


@query(W + "SELECT seq, principal, tenant FROM (SELECT seq, tenant, CASE WHEN seq % 2 = 0 THEN 'alice' ELSE 'bob' END AS principal FROM changes) WHERE tenant = 't3' OR (principal = 'alice' AND tenant IN ('t0', 't1')) OR (principal = 'bob' AND tenant = 't2')")
def rls_write(spark, d):
    rows = changes(spark, d).select("seq", "tenant", F.when(F.col("seq") % 2 == 0, "alice").otherwise("bob").alias("principal"))
    return G.writable(rows, _grants(spark), "t3").select("seq", "principal", "tenant")


@query(W + "SELECT seq, tenant, CASE WHEN tenant IS NULL THEN 'no_tenant' WHEN tenant LIKE '%.%' THEN 'bad_tenant' END AS error FROM (SELECT seq, CASE WHEN seq % 5 = 0 THEN 'x.y' WHEN seq % 2 = 0 THEN tenant WHEN seq % 3 = 0 THEN 't0' WHEN seq % 3 = 1 THEN 't2' END AS tenant FROM changes)")
def tenant_fill(spark, d):
    s = F.col("seq")
    rows = changes(spark, d).select("seq", F.when(s % 5 == 0, "x.y").when(s % 2 == 0, F.col("tenant")).when(s % 3 == 0, "").alias("tenant"), F.when(s % 3 == 0, "alice").when(s % 3 == 1, "bob").otherwise("eve").alias("principal"))
    return G.filled(rows, _grants(spark)).select("seq", "tenant", "error")


@query("SELECT min(c_custkey) AS c_custkey, c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment")
def dedupe_self_join(spark, d):
    c = T.scan(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))
    return c.join(first, c.columns, "left_semi")


@query("SELECT o_orderkey, 'ack.' || (o_custkey % 10) || '.' || o_orderkey AS subject FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS m FROM orders) WHERE m IS NOT NULL".replace("'ack.'", "'mutation_ack.'"))
def verdict_subjects(spark, d):
    o = T.scan(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("principal"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey").cast("string")).alias("msg_id"))
    return L.verdicts(o).select("o_orderkey", "subject")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'row_deleted' ELSE 'stale' END AS outcome FROM orders")
def write_outcome(spark, d):
    k = F.col("o_orderkey")
    return T.scan(spark, d, "orders").select(k, L.outcome((k % 3 == 0).cast("int"), k % 3 != 1, F.lit(None).cast("timestamp")).alias("outcome"))


_CLASSES = [("MissingHLC", "permanent"), ("InvalidHLCFormat", "permanent"), ("UnsupportedPayloadType", "permanent"), ("ForbiddenTable", "permanent"), ("RowTooLargeToReplicate", "permanent"), ("UnknownColumn", "permanent"), ("MissingData", "permanent"), ("NoPrimaryKey", "operator"), ("NoVersionColumn", "operator"), ("NoTombstoneColumn", "operator"), ("DbAllocatedKey", "operator"), ("MutationFailed", "transient"), ("Timeout", "transient"), (None, "transient")]


@query(f"SELECT * FROM {_rows(_CLASSES, 'error, class')}")
def error_classes(spark, d):
    return values(spark, [(e,) for e, _ in _CLASSES], "error string").select("error", S.error_class(F.col("error")).alias("class"))
