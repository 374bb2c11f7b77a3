"""Change operators on made-up rows."""

import pytest
from pyspark.sql import functions as F

from driftline.model import SpecRegistry, TableSpec
from driftline.operators import change, snapshot
from driftline.sources import tables


def test_copies_do_not_renew_the_window(spark):
    rows = [("a", i, 100 * i) for i in range(7)] + [("b", 10, 0), ("b", 11, 120), ("b", 12, 121), (None, 13, 0), (None, 14, 60)]
    df = spark.createDataFrame(rows, "msg_id string, seq long, at long").select("msg_id", "seq", F.timestamp_seconds("at").alias("arrived"))
    got = change.deduplicated(df.repartition(3))
    assert got.columns == df.columns
    assert sorted(r.seq for r in got.collect()) == [0, 2, 4, 6, 10, 12, 13]


def test_rejected_requests_do_not_extend_the_window(spark):
    rows = [("t", "a", i, 40 * i) for i in range(5)] + [("t", "b", 10, 0), ("t", "b", 11, 60), ("t", "b", 12, 61), ("u", "a", 13, 5)]
    df = spark.createDataFrame(rows, "tenant string, table string, seq long, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    got = change.debounced(df.repartition(3))
    assert got.columns == [*df.columns, "accepted"]
    assert sorted(r.seq for r in got.where("accepted").collect()) == [0, 2, 4, 10, 12, 13]


def test_unscoped_publications_are_refused(spark):
    from driftline.operators import guards

    public = spark.createDataFrame([("open",)], "table string")
    fine = spark.createDataFrame([("open", None, False), ("scoped", "a = 1", False), ("secured", None, True)], "table string, row_filter string, rls boolean")
    assert guards.publication_guard(fine, public).count() == 3
    with pytest.raises(guards.PreflightError, match="bare"):
        guards.publication_guard(fine.union(spark.createDataFrame([("bare", None, False)], fine.schema)), public)


def test_operator_faults_are_dead_lettered(spark):
    from driftline.operators import lww

    df = spark.createDataFrame([("", "NoPrimaryKey", 1, "users", 10), ("", "Timeout", 1, "users", 10)], "sqlstate string, error string, delivered int, table string, bytes long")
    assert [tuple(r)[:2] for r in lww.dead_letters(df).collect()] == [("mutation_error.users", "NoPrimaryKey")]


def greedy(sizes, budget):
    out, used, chunk = [], 0, 0
    for n in sizes:
        if used and used + n > budget:
            chunk, used = chunk + 1, 0
        used += n
        out.append(chunk)
    return out


def test_chunks_do_not_hang_on_the_partitions(spark):
    sizes = [(i, None if i == 5 else 900 if i == 77 else i * 37 % 60) for i in range(400)]
    df, seen = spark.createDataFrame(sizes, "id long, size int"), []
    for n in ("2", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.append([r.chunk for r in snapshot.packed_chunks(df.repartition(3), ["id"], "size", 100).orderBy("id").collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2] == greedy([n or 0 for _, n in sizes], 100)  # one segment
    assert snapshot.packed_chunks(df.limit(0), ["id"], "size", 100).count() == 0


def test_running_totals_of_a_hot_group(spark):
    rows = [("hot", i, 1) for i in range(300)] + [(None, i, 2) for i in range(50)] + [("z", 0, 5)]
    got = tables.ordered_prefix_sum(spark.createDataFrame(rows, "g string, n long, size int"), ["n"], F.col("size"), "total", by=("g",))
    assert got.columns == ["g", "n", "size", "total"]
    assert {(r.g, r.n): r.total for r in got.collect()} == {(g, n): (n + 1) * size for g, n, size in rows}


def test_batch_limits(spark):
    rows = [(1, i, 10, 0) for i in range(7)] + [(2, 10, 200, 0), (2, 11, 1, 0), (2, 12, None, 0), (3, 20, 1, 0), (3, 21, 1, 499), (3, 22, 1, 500), (3, 23, 1, None), (None, 30, 1, 0)]
    df = spark.createDataFrame(rows, "xid long, seq long, size int, ms long").withColumn("at", F.timestamp_millis("ms"))
    got = change.triggered(df.repartition(3), "size", "at", events=3, size_limit=100, wait_ms=500)
    assert got.columns == [*df.columns, "batch"]
    assert [(r.seq, r.batch) for r in got.orderBy("seq").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2), (10, 0), (11, 1), (12, 1), (20, 0), (21, 0), (22, 1), (23, 1), (30, 0)]


def test_bodies_of_batches(spark):
    rows = tables.generated(spark, 10, keys=3).withColumns({"seq": F.col("seq") + 1, "subject": F.lit("s"), "body": F.col("operation")})
    got = change.batch_bodies(rows, "body", 4).orderBy("batch").collect()
    assert [r.events for r in got] == [["INSERT", "UPDATE", "UPDATE", "DELETE"]] * 2 + [["INSERT", "UPDATE"]]
    assert tables.generated(spark, 5).collect() == tables.generated(spark, 5).repartition(2).orderBy("seq").collect()


def test_strict_mode(spark):
    from driftline.operators import guards

    found = spark.createDataFrame([("t", False)], "table string, refused_no_pk boolean")
    guards.strict(found)
    with pytest.raises(guards.PreflightError):
        guards.strict(found.withColumn("refused_no_pk", F.lit(True)))


def test_specifications_are_loaded_once_an_epoch():
    loads = []
    registry = SpecRegistry(lambda: loads.append(1) or [TableSpec("t", ("id",), ("id", "v"), epoch=len(loads))])
    assert registry.get(1)["t"].epoch == registry.get(1)["t"].epoch == 1 and registry.get(2)["t"].epoch == 2 and len(loads) == 2


def test_snapshots_are_whole_or_gone(spark, tmp_path):
    from driftline.sources import snapshots
    from driftline.sources.scratch import names_in

    path, rows = str(tmp_path), spark.range(10).withColumn("chunk", F.floor(F.col("id") / 4))
    snapshots.produce(rows, path, "t/1", "users", "s-1", 77, ("id",))
    bad = rows.withColumn("id", F.when(F.col("id") == 9, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        snapshots.produce(bad, path, "t/1", "users", "s-2", 78, ("id",), ("users", "carts"))
    read = lambda kind: [r.asDict() for r in spark.read.parquet(f"{path}/{kind}").collect()]
    assert read("descriptors") == [{"lsn": 77, "row_count": 10, "batch_count": 3, "tenant": "t/1", "table": "users", "snapshot_id": "s-1"}]
    assert len(read("starts")) == 2 and len(read("chunks")) == 10 and read("schemas")[0]["pk_ordinal"] == 1
    assert [(e["snapshot_id"], e["error_type"], e["available_tables"]) for e in read("errors")] == [("s-2", "generation_failed", ["users", "carts"])]
    assert names_in(spark, f"{path}/chunks/tenant=t%2F1/table=users") == ["snapshot_id=s-1"]
