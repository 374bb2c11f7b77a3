"""Queries over snapshots, schemas, preflight, metrics and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import guards as G
from driftline.operators import snapshot as P
from driftline.plans.base import CHANGES, changes, values
from driftline.plans.registry import query
from driftline.plans.write_queries import _rows
from driftline.sources import tables as T

W = f"WITH {CHANGES} "
_WIDTH = "24 + 24 * 3 + coalesce(octet_length(encode(text)), 0) + coalesce(octet_length(encode(role)), 0)"


def _turns(spark, d):
    t = T.scan(spark, d, "conversations")
    return t.withColumn("size", S.row_bytes([F.col("text"), F.col("role")], 3))


@query(f"SELECT max(s) AS max_bytes, floor(avg(s))::BIGINT AS avg_bytes, max(s) >= 1000 AS too_wide FROM (SELECT {_WIDTH} AS s FROM conversations)")
def row_width(spark, d):
    return P.widths(_turns(spark, d), F.col("size"), 1000)


_RUN = f"WITH r AS (SELECT conv_id, turn, {_WIDTH} AS size, sum({_WIDTH}) OVER (ORDER BY conv_id, turn)::BIGINT AS running FROM conversations) "


def _running(spark, d):
    return T.ordered_prefix_sum(_turns(spark, d).select("conv_id", "turn", "size"), ["conv_id", "turn"], F.col("size"), "running")


@query(_RUN + "SELECT conv_id, turn, running FROM r WHERE running <= 100000")
def running_bytes(spark, d):
    return _running(spark, d).where("running <= 100000").select("conv_id", "turn", "running")


@query(_RUN + "SELECT conv_id, turn, (running - 1) // 20000 AS chunk FROM r")
def snapshot_chunks(spark, d):
    return P.even_chunks(_running(spark, d), "running", 20000).select("conv_id", "turn", "chunk")


@query("WITH RECURSIVE" + _RUN.removeprefix("WITH") + """, g AS (SELECT conv_id, turn, size, (running - size) // 80000 AS segment FROM r),
 o AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY conv_id, turn) AS n FROM g),
 f AS (SELECT segment, n, conv_id, turn, size, 0::BIGINT AS k, size AS used FROM o WHERE n = 1 UNION ALL
  SELECT o.segment, o.n, o.conv_id, o.turn, o.size, CASE WHEN used > 0 AND used + o.size > 20000 THEN k + 1 ELSE k END, CASE WHEN used > 0 AND used + o.size > 20000 THEN o.size ELSE used + o.size END
  FROM f JOIN o ON o.segment = f.segment AND o.n = f.n + 1)
 SELECT conv_id, turn, size, segment::BIGINT * 4294967296 + k AS chunk FROM f""")
def packed_chunks(spark, d):
    return P.packed_chunks(_turns(spark, d).select("conv_id", "turn", "size"), ["conv_id", "turn"], "size", 20000, segment=4)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page_single(spark, d):
    return T.page(T.scan(spark, d, "orders"), ["o_orderkey"], [500], 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (5, 1) ORDER BY conv_id, turn LIMIT 100")
def keyset_page_composite(spark, d):
    return T.page(T.scan(spark, d, "conversations"), ["conv_id", "turn"], [5, 1], 100).select("conv_id", "turn", "role")


@query("WITH p AS (SELECT o_orderkey // 1000 AS chunk, max(o_orderkey) AS last_key FROM orders GROUP BY 1) SELECT chunk, last_key, last_key >= (SELECT max(o_orderkey) FROM orders) AS final FROM p")
def chunk_final_flag(spark, d):
    o = T.scan(spark, d, "orders")
    pages = o.groupBy(F.expr("o_orderkey div 1000").alias("chunk")).agg(F.max("o_orderkey").alias("last_key"))
    return P.final_flags(pages, o, "o_orderkey")


@query(_RUN + "SELECT 'snap-1700000000-00ff' AS snapshot_id, 'conversations' AS \"table\", 4096::BIGINT AS lsn, count(*) AS row_count, count(DISTINCT (running - 1) // 20000) AS batch_count FROM r")
def snapshot_descriptor(spark, d):
    return P.descriptor(P.even_chunks(_running(spark, d), "running", 20000), "conversations", "snap-1700000000-00ff", 4096)


def _descriptors(spark):
    return values(spark, [("users", "s1", 16778000), ("users", "s2", 16790000), ("carts", "s3", 16777000), ("orders", "s4", 16779000), ("gone", "s5", 1)], "table string, snapshot_id string, lsn long")


_DESC = "d AS (SELECT * FROM (VALUES ('users', 's1', 16778000), ('users', 's2', 16790000), ('carts', 's3', 16777000), ('orders', 's4', 16779000), ('gone', 's5', 1)) AS v(\"table\", snapshot_id, lsn)), st AS (SELECT \"table\", min(seq) AS first_seq, min(lsn) AS oldest_lsn FROM changes WHERE seq > 100 GROUP BY 1)"


def _streams(spark, d):
    return changes(spark, d).where("seq > 100").groupBy("table").agg(F.min("seq").alias("first_seq"), F.min("lsn").alias("oldest_lsn"))


@query(W + f", {_DESC} SELECT d.\"table\", snapshot_id, CASE WHEN first_seq IS NULL THEN false WHEN first_seq <= 1 THEN true ELSE lsn >= oldest_lsn END AS fresh FROM d LEFT JOIN st ON d.\"table\" = st.\"table\"")
def descriptor_fresh(spark, d):
    return P.freshness(_descriptors(spark), _streams(spark, d)).select("table", "snapshot_id", "fresh")


@query(W + f", {_DESC} SELECT d.\"table\", arg_max(snapshot_id, lsn) AS snapshot_id, max(lsn)::BIGINT AS lsn FROM d JOIN st ON d.\"table\" = st.\"table\" WHERE lsn >= oldest_lsn GROUP BY 1")
def snapshot_as_of(spark, d):
    return P.as_of(_descriptors(spark), _streams(spark, d))


@query("SELECT n_name AS \"table\", CASE WHEN n_nationkey % 3 = 0 THEN 'table_refused' ELSE 'table_not_monitored' END AS error_type FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0")
def snapshot_errors(spark, d):
    n = T.scan(spark, d, "nation").select(F.col("n_name").alias("table"), "n_nationkey")
    return P.errors(n, n.where("n_nationkey % 3 = 0").select("table", F.lit(True).alias("active")), n.where("n_nationkey % 2 <> 0").select("table")).select("table", "error_type")


@query("SELECT o_orderstatus AS \"table\", count(*) AS row_count, count(*) FILTER (o_orderkey % 100 > 0 OR o_orderstatus <> 'P') = count(*) AS complete FROM orders GROUP BY 1")
def snapshot_complete(spark, d):
    o = T.scan(spark, d, "orders").select(F.col("o_orderstatus").alias("table"), "o_orderkey")
    described = o.groupBy("table").agg(F.count("*").alias("row_count"))
    return P.complete(o.where("o_orderkey % 100 > 0 OR table <> 'P'"), described).select("table", "row_count", "complete")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn < 2")
def publication_filter(spark, d):
    return T.publication(T.scan(spark, d, "conversations"), ["conv_id", "turn", "role"], "turn < 2")


_DDL = """ddl AS (SELECT o_orderkey AS id, o_orderpriority AS "table", o_orderstatus AS schema, o_orderkey % 37 = 0 AS dropped FROM orders) """


def _ddl(spark, d):
    return T.scan(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("schema"), (F.col("o_orderkey") % 37 == 0).alias("dropped"))


@query(f"WITH {_DDL} SELECT \"table\", arg_max(schema, id) AS schema, max(id) AS id, arg_max(dropped, id) AS dropped FROM ddl GROUP BY 1")
def schema_latest(spark, d):
    return G.latest_schemas(_ddl(spark, d)).select("table", "schema", "id", "dropped")


@query(f"WITH {_DDL} SELECT id, \"table\", schema FROM (SELECT *, lag(schema) OVER (PARTITION BY \"table\" ORDER BY id) AS was FROM ddl) WHERE was IS DISTINCT FROM schema")
def schema_dedupe(spark, d):
    return G.changed_schemas(_ddl(spark, d)).select("id", "table", "schema")


@query("""SELECT r_regionkey, array_to_string(list_sort(list_filter(new, lambda x: NOT list_contains(old, x))), ',') AS added, array_to_string(list_sort(list_filter(old, lambda x: NOT list_contains(new, x))), ',') AS removed,
 array_to_string(list_sort(list_filter(old, lambda x: list_contains(new, x))), ',') AS common FROM (SELECT r_regionkey, ['id', 'name', 'note'] AS old, ['id', 'name', 'c' || r_regionkey] AS new FROM region)""")
def schema_diff(spark, d):
    r = T.scan(spark, d, "region")
    old, new = F.array(*map(F.lit, ("id", "name", "note"))), F.array(F.lit("id"), F.lit("name"), F.concat(F.lit("c"), F.col("r_regionkey")))
    return r.select("r_regionkey", *(F.array_join(c, ",").alias(n) for n, c in G.column_diff(old, new).items()))


@query(W + ", t AS (SELECT \"table\", lsn, seq % 200 < 150 AS ok FROM changes WHERE seq % 50 = 0), u AS (SELECT *, lag(ok) OVER (PARTITION BY \"table\" ORDER BY lsn) AS was FROM t), v AS (SELECT *, lead(lsn) OVER (PARTITION BY \"table\" ORDER BY lsn) AS resume_lsn FROM u WHERE ok IS DISTINCT FROM coalesce(was, true)), iv AS (SELECT \"table\", lsn AS a, resume_lsn AS b FROM v WHERE NOT ok) SELECT seq, \"table\" FROM changes c WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.\"table\" = c.\"table\" AND c.lsn >= a AND (b IS NULL OR c.lsn < b))")
def suspension_intervals(spark, d):
    c = changes(spark, d)
    ddl = c.where("seq % 50 = 0").select("table", "lsn", (F.col("seq") % 200 < 150).alias("ok"))
    return G.suspended(c.select("seq", "table", "lsn"), G.suspensions(ddl)).select("seq", "table")


@query("SELECT p_partkey, CASE WHEN dot = 0 THEN t || '.' || repeat('0', 8) ELSE t || repeat('0', greatest(0, 8 - (length(t) - dot))) END AS padded FROM (SELECT p_partkey, t, instr(t, '.') AS dot FROM (SELECT p_partkey, p_retailprice::DECIMAL(18, 2)::VARCHAR AS t FROM part))")
def numeric_pad(spark, d):
    text = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return T.scan(spark, d, "part").select("p_partkey", S.pad_numeric(text, S.declared_scale(F.lit("numeric(20,8)"))).alias("padded"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS naive, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS aware FROM events")
def ts_render(spark, d):
    ts = F.col("ts").cast("timestamp_ntz")
    return T.scan(spark, d, "events").select("event_id", S.ts_text(ts, False).alias("naive"), S.ts_text(ts, True).alias("aware"))


@query("SELECT o_orderkey, '{\"' || o_orderpriority || '\",NULL,\"a\\\"b\\\\c\"}' AS texts, '{{' || o_orderkey || ',2},{3,' || o_custkey || '}}' AS nums FROM orders")
def array_text(spark, d):
    texts = F.array(F.col("o_orderpriority"), F.lit(None), F.lit('a"b\\c'))
    k, c, long = F.col("o_orderkey"), F.col("o_custkey"), lambda n: F.lit(n).cast("long")
    nums = F.array(F.array(k, long(2)), F.array(long(3), c))
    return T.scan(spark, d, "orders").select("o_orderkey", S.array_text(texts, "text").alias("texts"), S.array_text(nums, "int", 2).alias("nums"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE (o_custkey % 200) * 4294967296 + o_orderkey END AS lsn FROM orders")
def lsn_parse(spark, d):
    o = T.scan(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 0, "nonsense").otherwise(S.lsn_text((F.col("o_custkey") % 200) * 4294967296 + F.col("o_orderkey")))
    return o.select("o_orderkey", S.lsn_parse(text).alias("lsn"))


@query("SELECT page_id, length(u) > 0 AND octet_length(encode(u)) <= 40 + 88 AND NOT regexp_matches(u, '[.*>\\x00-\\x20\\x7F]') AS valid, regexp_replace(u, '[.*>\\s]', '-', 'g') AS cleaned FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'page ' || page_id END AS u FROM pages)")
def token_valid(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("page "), F.col("page_id")))
    return T.scan(spark, d, "pages").select("page_id", S.token_valid(u).alias("valid"), S.token_clean(u).alias("cleaned"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'u' || o_custkey END AS principal, CASE WHEN o_orderkey % 3 < 2 THEN 'orders' END AS \"table\", CASE WHEN o_orderkey % 3 = 0 THEN 'insert' WHEN o_orderkey % 3 = 1 THEN 'delete' END AS operation FROM orders")
def subject_parse(spark, d):
    end = F.when(F.col("o_orderkey") % 3 == 0, "insert").when(F.col("o_orderkey") % 3 == 1, "delete").otherwise("insert.more")
    s = S.subject_parse(F.concat_ws(".", F.lit("mutations"), F.concat(F.lit("u"), F.col("o_custkey")), F.lit("orders"), end))
    return T.scan(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.principal", "s.table", "s.operation")


@query("SELECT n_nationkey, state, state[1:2] IN ('42', '23', '22', '3F', '0A') AS permanent FROM (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN '42P01' WHEN 1 THEN '23505' WHEN 2 THEN '3F000' WHEN 3 THEN '57014' WHEN 4 THEN '08006' ELSE '' END AS state FROM nation)")
def sqlstate_class(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("42P01", "23505", "3F000", "57014", "08006", ""))), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return T.scan(spark, d, "nation").select("n_nationkey", state.alias("state"), S.sqlstate_permanent(state).alias("permanent"))


#: Cases with their expected outcomes written out: name, type, precision, not null, verdict.
_VERSIONS = [
    ("updated_at", "timestamptz", -1, True, "usable"), ("updated_at", "timestamp", -1, True, "usable+naive"), ("updated_at", "timestamp", 0, True, "usable+naive+coarse"), ("updated_at", "timestamptz", 3, False, "usable+coarse+nullable"), ("updated_at", "timestamptz", 6, True, "usable"),
    ("created_at", "timestamptz", -1, True, "creation_column"), ("inserted_at", "timestamp", -1, True, "creation_column"), ("updated_at", None, 0, False, "absent"), ("created_at", None, 0, False, "absent"), ("updated_at", "text", -1, True, "wrong_type"), ("version", "int8", -1, True, "usable"), ("version", "int4", -1, False, "usable+nullable"), ("version", "numeric", -1, True, "wrong_type"),
]


@query(f"SELECT * FROM {_rows(_VERSIONS, 'name, type, precision, not_null, verdict')}")
def version_verdict(spark, d):
    rows = values(spark, [r[:4] for r in _VERSIONS], "name string, type string, precision int, not_null boolean")
    return rows.withColumn("verdict", S.version_verdict(F.col("name"), F.col("type"), F.col("precision"), F.col("not_null")))


#: Key columns, identity, rules -> refused, writes rejected, transitions inert.
_FINDINGS = [
    (1, "d", False, False, False, False), (0, "d", False, True, True, False), (0, "f", False, True, False, False), (0, "n", False, True, True, False), (0, "i", False, True, False, False), (2, "d", False, False, False, False),
    (1, "d", True, False, False, True), (1, "i", True, False, False, True), (1, "f", True, False, False, False), (0, "d", True, True, True, True), (1, "n", False, False, False, False), (0, "f", True, True, False, False),
]
_FOUND = f"SELECT * FROM {_rows(_FINDINGS, 'pk_columns, identity, has_rules, refused_no_pk, writes_rejected, transitions_inert')}"


def _tabs(spark):
    return values(spark, [r[:3] for r in _FINDINGS], "pk_columns int, identity string, has_rules boolean")


@query(_FOUND)
def table_findings(spark, d):
    return G.findings(_tabs(spark))


@query("SELECT 12::BIGINT AS checked, 8::BIGINT AS with_findings, 6::BIGINT AS refused")
def preflight_summary(spark, d):
    return G.preflight_summary(G.findings(_tabs(spark)))


_AUDITED = [("p", "ddl_events", None, False, "(none)", "internal — expected"), ("p", "users", None, False, "(none)", "PASS-THROUGH — every row reaches every subscriber of this publication"), ("p", "carts", None, True, "(none)", "CDC UNSCOPED — RLS bounds the snapshot, pgoutput ignores it"), ("q", "users", "tenant = 1", False, "tenant = 1", "reads scoped, WRITES UNSCOPED — no policy bounds what a principal may write"), ("q", "orders", "tenant = 1", True, "tenant = 1", "scoped")]


@query(f"SELECT publication, \"table\", shown AS row_filter, rls, verdict FROM {_rows(_AUDITED, 'publication, \"table\", f, rls, shown, verdict')}")
def audit_publications(spark, d):
    return G.publication_audit(values(spark, [r[:4] for r in _AUDITED], "publication string, table string, row_filter string, rls boolean"))


@query("SELECT * FROM (VALUES ('carts'), ('nation')) AS v(\"table\")")
def unscoped_publications(spark, d):
    added = [("users", None, True), ("carts", None, False), ("orders", "x > 1", False), ("region", None, False), ("nation", None, False), ("my_ddl_events", None, False), ("principal_tenants", None, False)]
    return G.unscoped(values(spark, added, "table string, row_filter string, rls boolean"), values(spark, [("region",), ("users",)], "table string")).select("table")


@query("SELECT * FROM (VALUES ('users', true, true, 'CREATE a | CREATE b'), ('carts', true, false, 'CREATE a'), ('orders', false, false, ''), ('nation', false, false, '')) AS v(\"table\", version_guard, delete_guard, detail)")
def audit_write_guards(spark, d):
    tables = values(spark, [("users",), ("carts",), ("orders",), ("nation",), ("ddl_events",)], "table string")
    triggers = [("users", "soft_delete", "CREATE b"), ("users", "bump_version", "CREATE a"), ("carts", "bump_version", "CREATE a"), ("orders", "other", "CREATE c"), ("ddl_events", "bump_version", "CREATE a")]
    return G.guard_audit(tables, values(spark, triggers, "table string, name string, definition string"))


_PLANS = {
    "no_write_half": [("preflight", "ERROR")],
    "no_column": [("preflight", "ERROR")],
    "unscoped": [("preflight", "ERROR")],
    "public": [("public", "would"), ("publication", "would"), ("T4 nats conf", "MANUAL"), ("summary", "DRY RUN")],
    "whole": [("grants", "done"), ("guards", "done"), ("rls", "done"), ("publication", "done"), ("publication", "NOTE"), ("T3 bridge env", "MANUAL"), ("T3 bridge env", "MANUAL"), ("T4 nats conf", "MANUAL")],
    "unguarded": [("grants", "would"), ("guards", "skipped"), ("rls", "would"), ("publication", "already"), ("T3 bridge env", "MANUAL"), ("T4 nats conf", "MANUAL"), ("summary", "DRY RUN")],
    "reads": [("rls", "done"), ("publication", "done"), ("T3 bridge env", "MANUAL"), ("T4 nats conf", "MANUAL")],
}


@query(f"SELECT \"table\", ordinal, step, status FROM {_rows([(t, i, *s) for t, steps in _PLANS.items() for i, s in enumerate(steps)], '\"table\", ordinal, step, status')}")
def enable_plan(spark, d):
    kinds = "table string, tenant_col string, tenant_col_known boolean, writable boolean, write_half boolean, version_col string, tombstone_col string, public_reason string, rls boolean, row_filter string, is_public boolean, published boolean, columns array<string>, dry_run boolean"
    asked = [
        ("no_write_half", "t", True, True, False, "v", None, None, False, None, False, False, None, True),
        ("no_column", "t", False, True, True, "v", None, None, False, None, False, False, None, True),
        ("unscoped", None, False, False, True, None, None, None, False, None, False, False, None, True),
        ("public", None, False, False, True, None, None, "open data", False, None, False, False, None, True),
        ("whole", "t", True, True, True, "v", "d", None, False, None, False, False, ["id", "t"], False),
        ("unguarded", "t", True, True, True, None, None, None, False, None, False, True, None, True),
        ("reads", "t", True, False, False, None, None, None, True, None, False, False, None, False),
    ]
    return G.plan_of(values(spark, asked, kinds))


@query("SELECT r_name, list_aggregate(list_sort(list(n_name)), 'string_agg', ',') AS tables, bool_or(n_nationkey > 20) AS any_late FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def publication_tables(spark, d):
    j = T.scan(spark, d, "region").join(T.scan(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("tables"), F.bool_or(F.col("n_nationkey") > 20).alias("any_late"))


@query("SELECT o_orderkey, lag, CASE WHEN lag >= 1073741824 THEN 'critical' WHEN lag >= 536870912 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT o_orderkey, o_orderkey * 100000 AS lag FROM orders)")
def lag_levels(spark, d):
    lag = F.col("o_orderkey") * 100000
    return T.scan(spark, d, "orders").select("o_orderkey", lag.alias("lag"), G.lag_level(lag).alias("level"))


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS events FROM events GROUP BY 1")
def rate_per_minute(spark, d):
    return G.rates(T.scan(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts")), "ts")


@query("WITH l AS (SELECT n_regionkey AS \"table\" FROM nation) SELECT max(n) AS widest, greatest(8, least(1600, ((max(n) + 7) // 8) * 8))::BIGINT AS slots FROM (SELECT count(*) AS n FROM l GROUP BY \"table\")")
def max_columns(spark, d):
    return G.max_columns(T.scan(spark, d, "nation").select(F.col("n_regionkey").alias("table")))


@query("SELECT * FROM (VALUES ('n_nationkey', 'int', 'INTEGER'), ('n_name', 'text', 'TEXT'), ('n_regionkey', 'int', 'INTEGER')) AS v(name, type, sqlite)")
def layout_scan(spark, d):
    return T.layout(T.scan(spark, d, "nation"), ("n_nationkey",)).select("name", "type", F.col("sqlite_type").alias("sqlite"))


_TYPES = [(t, "INTEGER") for t in "integer int int4 bigint int8 smallint int2 serial serial4 bigserial serial8 smallserial serial2 boolean bool".split()] + [(t, "REAL") for t in ("real", "float4", "double precision", "float8")] + [(t, "TEXT") for t in ("numeric", "decimal", "timestamp with time zone", "jsonb", "ARRAY", "uuid", "some_custom_enum")]


@query(f"SELECT * FROM {_rows(_TYPES, 'type, sqlite')}")
def schema_sqlite_map(spark, d):
    return values(spark, [(t,) for t, _ in _TYPES], "type string").withColumn("sqlite", S.sqlite_type(F.col("type")))


@query("SELECT page_id, CASE WHEN length(url) > 50 THEN url[1:47] || '...' ELSE url END AS shown, translate(split_part('x' || url || chr(10) || 'y', chr(10), 1), '\"', '''') AS error FROM pages")
def log_values(spark, d):
    return T.scan(spark, d, "pages").select("page_id", S.log_value(F.col("url")).alias("shown"), S.error_text(F.concat(F.lit("x"), F.col("url"), F.lit("\ny"))).alias("error"))


@query("SELECT n_nationkey, DATE '2000-01-01' + (n_nationkey * 400)::INT AS day FROM nation")
def pg_dates(spark, d):
    return T.scan(spark, d, "nation").select("n_nationkey", S.pg_date(F.col("n_nationkey") * 400).alias("day"))


@query("SELECT doc_id, '\\x' || lower(hex(encode(source))) AS raw, regexp_replace(md5(source), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uid FROM documents")
def binary_text(spark, d):
    raw = F.encode("source", "UTF-8")
    return T.scan(spark, d, "documents").select("doc_id", S.bytea_text(raw).alias("raw"), S.uuid_text(F.unhex(F.md5(raw))).alias("uid"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 't' ELSE 'f' END AS flag, o_custkey::VARCHAR AS num FROM orders")
def snapshot_fields(spark, d):
    return T.scan(spark, d, "orders").select("o_orderkey", S.snapshot_text(F.col("o_orderkey") % 2 == 0, "boolean").alias("flag"), S.snapshot_text(F.col("o_custkey"), "int").alias("num"))
