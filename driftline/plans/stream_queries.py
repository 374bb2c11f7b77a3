"""Queries over the change stream: normalising, routing, refusing, replicas, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import change as C
from driftline.operators import replica as R
from driftline.plans.base import CHANGES, changes, values
from driftline.plans.registry import query
from driftline.sources import tables as T

W = f"WITH {CHANGES} "


@query(W + """SELECT seq, lsn, xid, "table", operation, 'cdc.' || tenant || '.' || "table" || '.' || lower(operation) AS subject,
 printf('%x', lsn) || '-' || "table" || '-' || lower(operation) || '-' || seq AS msg_id FROM changes""")
def cdc_events(spark, d):
    return C.normalised(changes(spark, d), F.col("seq")).select("seq", "lsn", "xid", "table", "operation", "subject", "msg_id")


@query(W + """SELECT pk, seq, lsn, operation, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS r FROM changes) WHERE r = 1 AND operation <> 'DELETE'""")
def replica_latest(spark, d):
    return R.latest_rows(changes(spark, d).select("pk", "seq", "lsn", "operation", "event_type", "value"), ["pk"], ["seq"])


@query(W + """, mark AS (SELECT max(lsn) // 2 + 8388608 AS x FROM changes), base AS (SELECT pk, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS r FROM changes, mark WHERE lsn < x) WHERE r = 1 AND operation <> 'DELETE'),
 both_rows AS (SELECT pk, x AS lsn, 0 AS o, 'INSERT' AS operation, event_type, value FROM base, mark UNION ALL SELECT pk, lsn, 1, operation, event_type, value FROM changes, mark WHERE lsn >= x)
 SELECT pk, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY lsn DESC, o DESC) AS r FROM both_rows) WHERE r = 1 AND operation <> 'DELETE'""")
def replica_snapshot_plus_cdc(spark, d):
    c = changes(spark, d).select("table", "pk", "seq", "lsn", "operation", "event_type", "value")
    mark = F.broadcast(c.agg(F.expr("max(lsn) div 2 + 8388608").alias("snapshot_lsn")))
    marked = c.crossJoin(mark)  # one row
    snapshot = R.latest_rows(marked.where("lsn < snapshot_lsn"), ["pk"], ["seq"]).select("pk", F.col("snapshot_lsn").alias("lsn"), "event_type", "value")
    later = R.gated(c, c.select("table").distinct().crossJoin(mark)).select("pk", "lsn", "operation", "event_type", "value")
    return R.combined(snapshot, later, ["pk"]).select("pk", "event_type", "value")


@query(W + """, born AS (SELECT *, sum(CASE WHEN operation = 'DELETE' THEN 1 ELSE 0 END) OVER (PARTITION BY pk ORDER BY seq) AS generation, event_type IN ('click', 'view') AS kept FROM changes)
 SELECT pk, seq, operation, last_value(CASE WHEN kept THEN NULL ELSE value END IGNORE NULLS) OVER (PARTITION BY pk, generation ORDER BY seq) AS value, event_type FROM born""")
def replica_carry_forward(spark, d):
    kept = F.when(F.col("event_type").isin("click", "view"), F.array(F.lit("value"))).otherwise(F.array().cast("array<string>"))
    rows = changes(spark, d).withColumn("unchanged", kept)
    return R.carried(rows, ["pk"], "seq", ["value"]).select("pk", "seq", "operation", "value", "event_type")


@query(W + """SELECT pk, seq, CASE WHEN before IS NOT NULL AND before IS DISTINCT FROM event_type THEN 'transition' ELSE 'data' END AS class
 FROM (SELECT *, lag(event_type) OVER (PARTITION BY pk ORDER BY seq) AS before FROM changes) WHERE operation = 'UPDATE'""")
def transition_updates(spark, d):
    return C.transitions(changes(spark, d), "pk", "seq", ["event_type"]).where("operation = 'UPDATE'").select("pk", "seq", "class")


@query(W + """SELECT seq, CASE WHEN v IS NULL OR v LIKE '%.%' OR v = '' THEN 'unrouted' ELSE v END AS tenant FROM (SELECT seq, CASE WHEN pk % 5 = 0 THEN NULL WHEN pk % 7 = 0 THEN 'a.b' WHEN pk % 11 = 0 THEN '' ELSE tenant END AS v FROM changes)""")
def tenant_routed(spark, d):
    v = F.when(F.col("pk") % 5 == 0, None).when(F.col("pk") % 7 == 0, "a.b").when(F.col("pk") % 11 == 0, "").otherwise(F.col("tenant"))
    return C.routed(changes(spark, d), v).select("seq", "tenant")


def _refusals(spark):
    return values(spark, [("carts", "no_primary_key", True), ("orders", "row_too_large", False)], "table string, reason string, active boolean")


@query(W + """SELECT seq, "table", operation FROM changes WHERE "table" <> 'carts'""")
def refused_anti(spark, d):
    return C.without_refused(changes(spark, d), _refusals(spark)).select("seq", "table", "operation")


@query(W + """SELECT "table", 'no_primary_key' AS reason, count(*) AS dropped FROM changes WHERE "table" = 'carts' GROUP BY 1""")
def refused_counts(spark, d):
    return C.refused_counts(changes(spark, d), _refusals(spark))


@query(W + """SELECT seq, "table", operation FROM changes WHERE NOT (operation = 'DELETE' AND "table" = 'users')""")
def reap_suppressed(spark, d):
    return C.without_reaps(changes(spark, d), ["users"]).select("seq", "table", "operation")


@query(W + """SELECT seq, "table" FROM changes WHERE "table" NOT IN ('carts')""")
def internal_filtered(spark, d):
    return C.without_internal(changes(spark, d), ("carts",)).select("seq", "table")


@query(W + """SELECT seq, "table" FROM changes WHERE "table" IN ('users', 'orders')""")
def monitored_tables(spark, d):
    return C.monitored(changes(spark, d), values(spark, [("users",), ("shop.orders",), ("myusers",)], "monitored string")).select("seq", "table")


@query(W + """SELECT seq, c."table" FROM changes c WHERE "table" IN ('users', 'orders')""")
def relation_lookup(spark, d):
    rel = values(spark, [(100, "users"), (102, "orders")], "relation_id int, table string")
    rows = changes(spark, d).withColumn("relation_id", (F.col("pk") % 3 + 100).cast("int")).drop("table")
    return C.with_relation(rows.withColumn("relation_id", F.when(F.col("relation_id") == 101, 999).otherwise(F.col("relation_id"))), rel).select("seq", "table")


_WINDOWS = """firsts AS (SELECT {key}, min(moment) AS moment FROM timed GROUP BY {key} UNION ALL SELECT {named}, min(t.moment) FROM firsts f JOIN timed t ON {on} AND t.moment > f.moment + INTERVAL {s} SECOND GROUP BY {named})"""


@query("WITH RECURSIVE " + CHANGES + """, timed AS (SELECT seq, printf('%x', lsn) AS msg_id, ts AS moment FROM changes UNION ALL SELECT seq + 100000000, printf('%x', lsn), ts + INTERVAL 30 SECOND FROM changes WHERE seq % 10 = 0 UNION ALL SELECT seq + 200000000, printf('%x', lsn), ts + INTERVAL 100 SECOND FROM changes WHERE seq % 10 = 0 UNION ALL SELECT seq + 300000000, printf('%x', lsn), ts + INTERVAL 200 SECOND FROM changes WHERE seq % 10 = 0), """
 + _WINDOWS.format(key="msg_id", named="f.msg_id", on="t.msg_id = f.msg_id", s=120) + """ SELECT min(seq) AS seq, msg_id FROM timed JOIN firsts USING (msg_id, moment) GROUP BY msg_id, moment""")
def dedupe_msg_id(spark, d):
    """Copies at 0, 30, 100 and 200 s: the first and the last count."""
    c = changes(spark, d).select("seq", F.lower(F.hex("lsn")).alias("msg_id"), F.col("ts").alias("arrived"))
    late = lambda n, s: c.where(F.col("seq") % 10 == 0).select((F.col("seq") + n).alias("seq"), "msg_id", (F.col("arrived") + F.make_dt_interval(secs=F.lit(s))).alias("arrived"))
    return C.deduplicated(c.union(late(100000000, 30)).union(late(200000000, 100)).union(late(300000000, 200))).select("seq", "msg_id")


@query(W + """SELECT seq, xid FROM changes WHERE xid % 7 <> 0""")
def committed_only(spark, d):
    c = changes(spark, d)
    return C.committed(c, c.where("xid % 7 <> 0").select("xid")).select("seq", "xid")


@query(W + """SELECT batch, subject, count(*) AS events, min(lsn) AS first_lsn, max(lsn) AS last_lsn, 'batch-' || printf('%x', min(lsn)) || '-to-' || printf('%x', max(lsn)) AS batch_msg_id
 FROM (SELECT (seq - 1) // 500 AS batch, 'cdc.' || tenant || '.' || "table" || '.' || lower(operation) AS subject, lsn FROM changes WHERE seq > 0) GROUP BY 1, 2""")
def batch_by_subject(spark, d):
    return C.batches(C.normalised(changes(spark, d).where("seq > 0")), 500)


@query("WITH RECURSIVE " + CHANGES + """, r AS (SELECT seq, xid, octet_length(encode(event_type)) AS size, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY xid ORDER BY seq) AS n FROM changes),
 f AS (SELECT xid, seq, n, 0::BIGINT AS batch, 1 AS c, size AS b, ms AS since FROM r WHERE n = 1 UNION ALL
  SELECT r.xid, r.seq, r.n, CASE WHEN c >= 4 OR b >= 18 OR r.ms - since >= 900000 THEN batch + 1 ELSE batch END, CASE WHEN c >= 4 OR b >= 18 OR r.ms - since >= 900000 THEN 1 ELSE c + 1 END,
   CASE WHEN c >= 4 OR b >= 18 OR r.ms - since >= 900000 THEN size ELSE b + size END, CASE WHEN c >= 4 OR b >= 18 OR r.ms - since >= 900000 THEN r.ms ELSE since END FROM f JOIN r ON r.xid = f.xid AND r.n = f.n + 1)
 SELECT xid, seq, batch FROM f""")
def batch_triggers(spark, d):
    rows = changes(spark, d).select("xid", "seq", "ts", F.octet_length("event_type").alias("size"))
    return C.triggered(rows, "size", "ts", events=4, size_limit=18, wait_ms=900_000).select("xid", "seq", "batch")


@query(W + """SELECT seq, octet_length(encode(event_type)) + octet_length(encode("table")) + octet_length(encode(operation)) + octet_length(encode('cdc.' || "table")) + 256 AS bytes FROM changes""")
def event_wire_size(spark, d):
    c = changes(spark, d)
    return c.select("seq", S.wire_bytes(F.col("event_type"), F.col("table"), F.col("operation"), F.concat(F.lit("cdc."), F.col("table"))).alias("bytes"))


@query(W + """, s AS (SELECT tenant AS stream, min(seq) + (CASE tenant WHEN 't1' THEN 500 ELSE 0 END) AS first_seq FROM changes GROUP BY tenant)
 SELECT stream, first_seq, seq, seq = 0 OR (first_seq > 0 AND seq < first_seq - 1) AS gap FROM (SELECT stream, first_seq, (CASE stream WHEN 't0' THEN 0 WHEN 't1' THEN 100 ELSE 50 END)::BIGINT AS seq FROM s)""")
def gap_check(spark, d):
    s = changes(spark, d).groupBy(F.col("tenant").alias("stream")).agg(F.min("seq").alias("lo")).select("stream", (F.col("lo") + F.when(F.col("stream") == "t1", 500).otherwise(0)).alias("first_seq"))
    seen = s.where("stream <> 't0'").select("stream", F.when(F.col("stream") == "t1", 100).otherwise(50).cast("long").alias("seq"))
    return C.gaps(seen, s).select("stream", "first_seq", "seq", "gap")


@query(W + """SELECT seq, CASE WHEN pk % 9 = 0 THEN 'DEL' WHEN operation = 'INSERT' THEN 'INS' WHEN operation = 'UPDATE' THEN 'UP' ELSE 'DEL' END AS verb FROM changes""")
def display_verb(spark, d):
    return changes(spark, d).select("seq", C.display_verb(F.col("operation"), F.when(F.col("pk") % 9 == 0, F.col("ts"))).alias("verb"))


@query("""SELECT c_custkey AS principal, stream FROM customer, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['public'] ELSE [c_mktsegment, 'public'] END) AS t(stream)""")
def stream_choice(spark, d):
    c = T.scan(spark, d, "customer").select(F.col("c_custkey").alias("principal"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("tenant"))
    return C.streams_for(c).select("principal", "stream")


@query("WITH RECURSIVE " + CHANGES + """, timed AS (SELECT seq, tenant, "table", ts AS moment FROM changes), """ + _WINDOWS.format(key='tenant, "table"', named='f.tenant, f."table"', on='t.tenant = f.tenant AND t."table" = f."table"', s=3600)
 + """, passed AS (SELECT min(seq) AS seq FROM timed JOIN firsts USING (tenant, "table", moment) GROUP BY tenant, "table", moment) SELECT seq, tenant, "table", seq IN (SELECT seq FROM passed) AS accepted FROM changes""")
def request_debounce(spark, d):
    return C.debounced(changes(spark, d), 3600).select("seq", "tenant", "table", "accepted")


@query(W + """, moved AS (SELECT *, CASE WHEN operation = 'UPDATE' AND seq % 50 = 0 THEN pk + 100000 ELSE pk END AS new_pk FROM changes),
 parts AS (SELECT new_pk AS pk, seq, 1 AS ord, CASE WHEN new_pk <> pk THEN 'INSERT' ELSE operation END AS operation FROM moved UNION ALL SELECT pk, seq, 0, 'DELETE' FROM moved WHERE new_pk <> pk)
 SELECT pk, seq, operation FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC, ord DESC) AS r FROM parts) WHERE r = 1 AND operation <> 'DELETE'""")
def replica_key_change(spark, d):
    moved = (F.col("operation") == "UPDATE") & (F.col("seq") % 50 == 0)
    c = changes(spark, d).select("seq", "operation", F.when(moved, F.col("pk")).alias("old_pk"), F.when(moved, F.col("pk") + 100000).otherwise(F.col("pk")).alias("pk"))
    return R.latest_rows(R.key_changes(c, "pk", "old_pk"), ["pk"], ["seq", "ord"]).select("pk", "seq", "operation")


@query(W + """, cut AS (SELECT max(lsn) // 2 + 8388608 AS x FROM changes)
 SELECT pk, seq FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS r FROM changes, cut WHERE "table" <> 'users' OR lsn > x) WHERE r = 1 AND operation <> 'DELETE'""")
def replica_truncate(spark, d):
    c = changes(spark, d)
    cut = c.agg(F.expr("max(lsn) div 2 + 8388608").alias("lsn")).select(F.lit("users").alias("table"), "lsn")
    return R.latest_rows(R.truncated(c, cut).select("pk", "seq", "operation"), ["pk"], ["seq"]).select("pk", "seq")


@query(W + """SELECT seq, CASE WHEN pk % 4 = 0 AND lsn < 16787216 THEN 'strip' WHEN pk % 4 = 0 THEN 'hold' ELSE 'apply' END AS verdict, CASE WHEN pk % 4 = 0 AND lsn >= 16787216 THEN 'id,name,extra' ELSE 'id,name' END AS applied FROM changes""")
def schema_race(spark, d):
    cols = F.when(F.col("pk") % 4 == 0, F.array(*map(F.lit, ("id", "name", "extra")))).otherwise(F.array(*map(F.lit, ("id", "name"))))
    schemas = values(spark, [(t, lsn, c) for t in ("users", "carts", "orders") for lsn, c in ((1, ["id"]), (16787216, ["id", "name"]))], "table string, lsn long, columns array<string>")
    return R.raced(changes(spark, d).select("seq", "lsn", "table", cols.alias("columns")), schemas).select("seq", "verdict", F.array_join("applied", ",").alias("applied"))


@query(W + """SELECT pk, seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS r FROM changes) WHERE r = 1""")
def whole_row_cache(spark, d):
    return R.whole_row_cache(changes(spark, d).select("pk", "seq", "event_type"), ["pk"], "seq")


@query(W + """SELECT tenant AS key, max(seq) AS seq, arg_max(event_type, seq) AS value FROM changes GROUP BY tenant HAVING arg_max(operation, seq) <> 'DELETE'""")
def kv_view(spark, d):
    log = changes(spark, d).select(F.col("tenant").alias("key"), "seq", F.col("event_type").alias("value"), (F.col("operation") == "DELETE").alias("deleted"))
    return T.kv_view(log).select("key", "seq", "value")


@query(W + """SELECT seq, sum(CASE WHEN seq % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "table" ORDER BY seq)::BIGINT AS run FROM changes""")
def schema_runs(spark, d):
    return C.schema_runs(changes(spark, d).withColumn("is_schema", F.col("seq") % 97 == 0)).select("seq", "run")


@query(W + "SELECT seq, lsn FROM changes WHERE seq > 700")
def resume_from(spark, d):
    return T.resume(changes(spark, d), 700).select("seq", "lsn")


@query(W + "SELECT max(lsn) AS current_lsn FROM changes")
def current_lsn(spark, d):
    return T.current_lsn(changes(spark, d))


@query(W + """SELECT seq, k AS event_type FROM changes, unnest(CASE WHEN seq % 3 = 0 THEN [event_type, 'copy'] ELSE [event_type] END) AS t(k)""")
def batch_or_single(spark, d):
    one = F.to_json(F.struct("event_type"))
    body = F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" ["), one, F.lit(',{"event_type":"copy"}]'))).otherwise(one)
    return T.unbatched(changes(spark, d).select("seq", body.alias("body")), "body", "struct<event_type:string>").select("seq", "item.event_type")
