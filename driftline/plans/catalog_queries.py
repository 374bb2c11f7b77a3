"""Queries over catalogs, payloads, widths and counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from driftline.operators import catalog as K
from driftline.operators import guards as G
from driftline.operators import snapshot as P
from driftline.plans.base import CHANGES, changes
from driftline.plans.registry import query
from driftline.sources import tables as T

W = f"WITH {CHANGES} "


@query("SELECT n_nationkey AS ordinal, n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS pk_ordinal FROM nation")
def key_layout(spark, d):
    n = T.scan(spark, d, "nation")
    attributes = n.select(F.col("n_regionkey").alias("table"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"))
    indexes = n.groupBy(F.col("n_regionkey").alias("table")).agg(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 5 < 2, F.struct((-(F.col("n_nationkey") % 5)).alias("o"), "n_nationkey")))).alias("k"))
    one_by_one = indexes.select("table", F.explode_outer("k").alias("k")).select("table", F.when(F.col("k").isNotNull(), F.array("k.n_nationkey")).alias("key"), (-F.col("k.o")).alias("m"))
    keys = one_by_one.select("table", "key", "m")
    out = K.layouts(attributes, keys.select("table", "key")).join(keys.select(F.col("key")[0].alias("ordinal"), "m"), "ordinal", "left")
    return out.select("ordinal", "name", F.when(F.col("m") == 0, 2).when(F.col("m") == 1, 1).alias("pk_ordinal"))


@query("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN supplier ON s_suppkey = c_custkey")
def publication_catalog(spark, d):
    r = T.scan(spark, d, "region").select(F.col("r_regionkey").alias("table_id"), "r_name")
    n = T.scan(spark, d, "nation").select(F.col("n_regionkey").alias("table_id"), "n_name", F.col("n_nationkey").alias("nation"))
    c = T.scan(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("type_id"), F.col("c_nationkey").alias("nation"))
    tables = n.join(c, "nation").select("table_id", "n_name", "c_custkey", "type_id")
    types = T.scan(spark, d, "supplier").select(F.col("s_suppkey").alias("type_id"))
    return K.published(r, tables, r.select("table_id"), types).select("r_name", "n_name", "c_custkey")


def _payload(spark, d):
    c = changes(spark, d)
    return c.select("seq", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("tenant"), F.col("tenant")).alias("data"), F.create_map(F.lit("kind"), F.lit("was")).alias("old"), F.when(F.col("seq") % 2 == 0, F.array(F.lit("tenant"))).otherwise(F.array().cast("array<string>")).alias("unchanged"))


@query(W + "SELECT seq, event_type AS kind, 'was' AS old_kind, 3 AS n FROM changes")
def old_values(spark, d):
    return K.with_old(_payload(spark, d)).select("seq", F.element_at("data", "kind").alias("kind"), F.element_at("data", "old.kind").alias("old_kind"), F.size("data").alias("n"))


@query(W + "SELECT seq, CASE WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS n FROM changes")
def unchanged_omitted(spark, d):
    return K.without_unchanged(_payload(spark, d)).select("seq", F.size("data").alias("n"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def view_projection(spark, d):
    return K.view(T.scan(spark, d, "customer"), ["c_acctbal", "c_mktsegment"])


@query("SELECT n_nationkey, n_nationkey % 2 <> 0 AND n_nationkey % 3 <> 0 AS required FROM nation")
def required_columns(spark, d):
    k = F.col("n_nationkey")
    return T.scan(spark, d, "nation").select(k, K.required(k % 2 == 0, F.when(k % 3 == 0, "x")).alias("required"))


@query("""SELECT 'customer' AS "table", max(24 + 24 * 3 + octet_length(encode(c_name)) + octet_length(encode(c_mktsegment))) AS max_bytes, max(24 + 24 * 3 + octet_length(encode(c_name)) + octet_length(encode(c_mktsegment))) < 130 AS fits FROM customer
 UNION ALL SELECT 'pages', max(24 + 24 + octet_length(encode(url)) + octet_length(encode(html))), max(24 + 24 + octet_length(encode(url)) + octet_length(encode(html))) < 130 FROM pages""")
def widest_rows(spark, d):
    return K.widest_rows({t: T.scan(spark, d, t) for t in ("customer", "pages")}, 130)


@query("""SELECT 'part' AS "table", p_name AS "column", octet_length(encode(p_type))::INTEGER AS bytes FROM part WHERE octet_length(encode(p_type)) >= 6""")
def oversized_defaults(spark, d):
    return K.oversized_defaults(T.scan(spark, d, "part").select(F.lit("part").alias("table"), F.col("p_name").alias("column"), F.col("p_type").alias("default_text")), 6)


@query("SELECT c_mktsegment AS principal, string_agg(DISTINCT 't' || (c_nationkey % 7), ',' ORDER BY 't' || (c_nationkey % 7)) AS tenants FROM customer GROUP BY 1")
def tenants_per_principal(spark, d):
    return K.tenants_of(T.scan(spark, d, "customer").select(F.col("c_mktsegment").alias("principal"), F.concat(F.lit("t"), F.col("c_nationkey") % 7).alias("tenant")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' - INTERVAL 2 DAY")
def ddl_retention(spark, d):
    o = T.scan(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return K.retained(o, "o_orderdate", F.lit(datetime(1996, 6, 1)).cast("timestamp_ntz"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'not_wanted' WHEN n_nationkey % 3 = 0 THEN 'key_allocated_by_database' WHEN n_nationkey % 5 = 0 THEN 'grant_missing' ELSE 'writable' END AS verdict FROM nation")
def write_intent(spark, d):
    k = F.col("n_nationkey")
    return K.write_intent(T.scan(spark, d, "nation").select(k, (k % 4 != 0).alias("wanted"), (k % 5 != 0).alias("granted"), (k % 3 == 0).alias("key_allocated"))).select("n_nationkey", "verdict")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'no_tenant_column' WHEN 2 THEN 'tenant_not_in_replica_identity' END AS reason FROM nation")
def tenant_findings(spark, d):
    k = F.col("n_nationkey") % 4
    rows = T.scan(spark, d, "nation").select("n_nationkey", F.when(k > 0, "tenant").alias("tenant_column"), F.when(k == 1, F.array(F.lit("id"))).otherwise(F.array(F.lit("id"), F.lit("tenant"))).alias("columns"), F.when(k == 3, F.array(F.lit("tenant"), F.lit("id"))).otherwise(F.array(F.lit("id"))).alias("identity_columns"))
    return K.tenant_findings(rows).select("n_nationkey", "reason")


@query("SELECT n_regionkey AS \"table\", n_regionkey <> 2 AS key_ok FROM (SELECT DISTINCT n_regionkey FROM nation)")
def key_ordinals(spark, d):
    n = T.scan(spark, d, "nation").groupBy("n_regionkey").count()
    rows = n.select(F.col("n_regionkey").alias("table"), F.explode(F.when(F.col("n_regionkey") == 2, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(1)))).alias("pk_ordinal"))
    return P.key_ordinals(rows)


@query(W + "SELECT count(*) AS messages, count(*) FILTER (event_type <> 'view' AND event_type <> 'error') AS events, count(*) FILTER (event_type = 'error') AS connects, max(lsn) AS last_lsn FROM changes")
def log_counters(spark, d):
    kind = F.when(F.col("event_type") == "view", "keepalive").when(F.col("event_type") == "error", "connect").otherwise("data")
    return K.counters(changes(spark, d).select("lsn", kind.alias("kind")))


@query("""SELECT n_regionkey AS "table", '[' || string_agg('{"name":"' || n_name || '","type":"int"}', ',' ORDER BY n_nationkey) || ']' AS columns, coalesce(string_agg(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, ',' ORDER BY n_nationkey DESC), '') AS pk_columns FROM nation GROUP BY 1""")
def columns_json(spark, d):
    k = F.col("n_nationkey")
    layout = T.scan(spark, d, "nation").select(F.col("n_regionkey").alias("table"), k.alias("ordinal"), F.col("n_name").alias("name"), F.lit("int").alias("type"), F.when(k % 2 == 0, -k).alias("pk_ordinal"))
    return G.columns_json(layout)


@query(W + "SELECT DISTINCT tenant FROM changes WHERE operation = 'DELETE'")
def tombstone_tenants(spark, d):
    return changes(spark, d).where("operation = 'DELETE'").select("tenant").distinct()


@query(W + """, p AS (SELECT seq, CASE WHEN seq < 128 THEN lpad(to_hex(seq), 2, '0') ELSE 'd3' || lpad(to_hex(seq), 16, '0') END AS a,
  to_hex(160 + octet_length(encode("table"))) || hex(encode("table")) AS b, to_hex(160 + octet_length(encode(operation))) || hex(encode(operation)) AS c,
  CASE WHEN value IS NULL THEN 'c0' ELSE 'cb' || hex(value::BIT::BLOB) END AS v FROM changes)
 SELECT seq, lower('84a3' || hex('seq'::BLOB) || a || 'a5' || hex('table'::BLOB) || b || 'a9' || hex('operation'::BLOB) || c || 'a5' || hex('value'::BLOB) || v) AS body FROM p""")
def packed_events(spark, d):
    return K.encoded(changes(spark, d), "seq", ["seq", "table", "operation", "value"]).select("seq", F.lower(F.hex("body")).alias("body"))
