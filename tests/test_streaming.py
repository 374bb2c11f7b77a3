import pytest
from pyspark.sql import functions as F

from driftline.streaming import flows

ROW = "xid long, kind string, seq long, body string"


def run(spark, df, path, mode="append"):
    name = f"q{abs(hash(str(path)))}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def source(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"in/b={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in/*"))


def test_transactions_leave_whole_and_in_order(spark, tmp_path):
    df = source(spark, tmp_path, [[(1, "row", 2, "b"), (1, "row", 1, "a"), (2, "row", 3, "c")], [(1, "commit", 4, "")]], ROW)
    assert run(spark, flows.committed(df, "xid long, seq long, body string"), tmp_path) == [(1, 1, "a"), (1, 2, "b")]


def test_events_wait_for_their_schema(spark, tmp_path):
    schema = "table string, kind string, lsn long, columns string, body string"
    df = source(spark, tmp_path, [[("t", "schema", 1, "", "id"), ("t", "row", 2, "id", "x"), ("t", "row", 5, "id,n", "y"), ("u", "row", 6, "", "z")], [("t", "schema", 4, "", "id,n")]], schema)
    assert sorted(run(spark, flows.held_until_known(df, 3), tmp_path)) == [("t", 2, "id", "x"), ("t", 5, "id,n", "y")]


def test_dropped_columns_are_stripped_from_older_events(spark, tmp_path):
    schema = "table string, kind string, lsn long, columns string, body string"
    late = [("t", "row", 3, "id,gone", "old"), ("t", "row", 9, "id,new", "wait"), ("t", "schema", 2, "", "id,gone")]
    df = source(spark, tmp_path, [[("t", "schema", 5, "", "id,n")], late, [("t", "row", 4, "gone", "none"), ("t", "schema", 10, "", "id,new")]], schema)
    assert sorted(run(spark, flows.held_until_known(df, 2), tmp_path)) == [("t", 3, "id", "old"), ("t", 4, "", "none"), ("t", 9, "id,new", "wait")]


def test_a_log_starts_at_a_position(spark, tmp_path):
    from driftline.sources import tables

    spark.createDataFrame([(n, f"v{n}") for n in range(5)], "lsn long, v string").write.parquet(str(tmp_path / "log"))
    got = run(spark, tables.log_stream(spark, str(tmp_path / "log"), "lsn long, v string", from_lsn=3), tmp_path)
    assert sorted(got) == [(3, "v3"), (4, "v4")]


def test_duplicates_in_the_window_go(spark, tmp_path):
    df = source(spark, tmp_path, [[("m1", "2024-01-01 00:00:00"), ("m1", "2024-01-01 00:00:30"), ("m2", "2024-01-01 00:00:40")]], "msg_id string, at string")
    got = run(spark, flows.deduplicated(df.select("msg_id", F.col("at").cast("timestamp").alias("ts"))), tmp_path)
    assert sorted(m for m, _ in got) == ["m1", "m2"]


def test_replica_sink_applies_each_batch_once(spark, tmp_path):
    schema = "pk long, seq long, operation string, v string"
    batches = [[(1, 1, "INSERT", "a"), (2, 2, "INSERT", "b")], [(1, 3, "UPDATE", "c"), (2, 4, "DELETE", None)]]
    sink = flows.ReplicaSink(str(tmp_path / "out"), ["pk"], ["seq"])
    assert sink.live(spark) is None
    for i, rows in enumerate(batches):
        for _ in range(2):  # the second call is a replay
            sink(spark.createDataFrame(rows, schema), i)
    assert [tuple(r) for r in sink.live(spark).collect()] == [(1, 3, "UPDATE", "c")]
    sink(spark.createDataFrame([(2, 3, "INSERT", "late")], schema), 2)
    assert sink.live(spark).count() == 1  # older than the delete


def test_replica_sink_compacts_and_tidies(spark, tmp_path):
    from driftline.sources.scratch import names_in

    sink, out = flows.ReplicaSink(str(tmp_path / "out"), ["pk"], ["seq"], compact=3), str(tmp_path / "out")
    for i in range(9):
        sink(spark.createDataFrame([(k, 10 * i + k, "DELETE" if (i, k) == (7, 1) else "UPDATE", f"{i}-{k}") for k in {i % 4, 1}], "pk long, seq long, operation string, v string"), i)
        assert len(names_in(spark, f"{out}/pointer")) <= 2 and len(sink.pointer(spark)["tables"]) <= 3
    assert len(names_in(spark, f"{out}/tables")) <= 6
    assert sorted(tuple(r)[::3] for r in sink.live(spark).collect()) == [(0, "8-0"), (1, "8-1"), (2, "6-2"), (3, "7-3")]


def test_answers_and_time_outs(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.col(s))
    writes = source(spark, tmp_path / "w", [[("a", 1000), ("b", 1001)], [("c", 1100)]], "msg_id string, s long").select("msg_id", at("s").alias("written"))
    verdicts = source(spark, tmp_path / "v", [[("a", "ok", 1003)], [("z", "ok", 1100)]], "msg_id string, status string, s long").select("msg_id", "status", at("s").alias("judged"))
    got = run(spark, flows.answered(writes, verdicts), tmp_path)
    assert sorted((m, s) for m, _, s in got) == [("a", "ok"), ("b", "timed_out")]


def test_requests_are_taken_one_by_one_and_once(spark, tmp_path):
    seen, failures = [], []

    def handle(row):
        seen.append(row.seq)
        if row.seq == 2:
            raise ValueError("no")

    queue = flows.RequestQueue(str(tmp_path / "acks"), handle, lambda row, e: failures.append((row.seq, str(e))))
    batch = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "seq long, table string")
    for n in (0, 0, 1):
        queue(batch if n == 0 else batch.where("seq = 3"), n)
    assert seen == [1, 2, 3, 3] and failures == [(2, "no")]


def test_writes_come_again_until_they_are_dead(spark, tmp_path):
    seen, dead = [], []

    def apply(df):
        seen.append(sorted((r.seq, r.delivered) for r in df.collect()))
        return df.withColumns({"acked": (F.col("seq") == 1) | ((F.col("seq") == 2) & (F.col("delivered") == 2)), "permanent": F.col("seq") == 4})

    queue = flows.MutationQueue(str(tmp_path / "waiting"), apply, lambda df: dead.extend((r.seq, r.delivered) for r in df.collect()), most=3)
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "seq long")
    for n in (0, 1, 1, 2, 3):
        queue(rows.where("true" if n == 0 else "false"), n)
    assert seen == [[(1, 1), (2, 1), (3, 1), (4, 1)], [(2, 2), (3, 2)], [(2, 2), (3, 2)], [(3, 3)], []]
    assert dead == [(4, 1), (3, 3)] and queue.waiting(spark).count() == 0


def test_schemas_are_written_before_rows(spark):
    seen = []
    write = flows.schemas_first(lambda df, n: seen.append(("schemas", n, df.count())), lambda df, n: seen.append(("rows", n, df.count())))
    write(spark.createDataFrame([(True,), (False,), (False,)], "is_schema boolean"), 7)
    assert seen == [("schemas", 7, 1), ("rows", 7, 2)]


def test_backfill_and_progress(spark, tmp_path):
    static = spark.createDataFrame([(1, "a")], "id long, v string")
    live = spark.createDataFrame([(2,)], "id long")
    assert sorted(tuple(r) for r in flows.backfilled(static, live).collect()) == [(1, "a"), (2, None)]
    df = source(spark, tmp_path, [[(1,), (2,)], [(3,)]], "id long")
    q = df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert flows.progress(q)["batch"] == 1 and flows.progress(q)["rows"] == 1


@pytest.mark.parametrize("mode", ["append"])
def test_rates(spark, tmp_path, mode):
    df = source(spark, tmp_path, [[("t", "2024-01-01 00:00:00"), ("t", "2024-01-01 00:00:30")], [("t", "2024-01-01 00:10:00")]], "table string, at string")
    got = run(spark, flows.rates(df.select("table", F.col("at").cast("timestamp").alias("ts"))), tmp_path, mode)
    assert [(t, n) for _, t, n in got][:1] == [("t", 2)]
