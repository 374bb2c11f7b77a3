"""Structured Streaming forms: dedupe, transactions, replica state, hold-and-drain, verdict timeouts, rates."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.model import MAX_DELIVER
from driftline.sources.scratch import make_folder, names_in, remove, written


def deduplicated(events: DataFrame, ts: str = "ts", window: str = "2 minutes") -> DataFrame:
    """One event per message id within the window; state leaves with the watermark."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(["msg_id"])


def rates(events: DataFrame, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w"), "table").agg(F.count("*").alias("events")).select(F.col("w.start").alias("minute"), "table", "events")


def committed(events: DataFrame, row_schema: str, timeout_ms: int = 600_000) -> DataFrame:
    """Rows of a transaction wait for its commit and leave together, in order; rows of one that never
    commits leave the state at the timeout. events: xid, kind (row or commit), seq, body (text)."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held, done = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        for pdf in frames:
            done = done or bool((pdf["kind"] == "commit").any())
            rows = pdf[pdf["kind"] == "row"]
            held += [f"{s:020d}{b}" for s, b in zip(rows["seq"], rows["body"], strict=True)]
        if done and held:
            held.sort()
            yield pd.DataFrame({"xid": [key[0]] * len(held), "seq": [int(h[:20]) for h in held], "body": [h[20:] for h in held]})
            held = []
        state.update((held, done))
        state.setTimeoutDuration(timeout_ms)

    return events.groupBy("xid").applyInPandasWithState(step, row_schema, "held array<string>, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def held_until_known(events: DataFrame, shards: int = 16) -> DataFrame:
    """The schema race of replica.raced, as a stream: (table, lsn, columns, body) of the events that may be applied, with
    the columns to apply. Per table the schema with the greatest lsn counts. An event with a column that it lacks is
    stripped of it if the event is older than the schema, and waits for the next schema if not, however long: an event
    is never dropped. Schemas are applied before the rows of their batch.

    events: table, kind (schema or row), lsn, columns, body; a schema's body is its columns, comma-joined. A table's rows
    are dealt over `shards` states by lsn, and its schemas go to each, so no table is one task. Order among shards is not
    kept: readers fold by lsn."""
    shard = F.when(F.col("kind") == "schema", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("lsn"), F.lit(shards)).cast("int")))
    dealt = events.select("*", F.explode(shard).alias("__shard"))

    def step(key, frames, state: GroupState):
        known, at, held = (set(state.get[0]), state.get[1], [json.loads(x) for x in state.get[2]]) if state.exists else (set(), None, [])
        for pdf in frames:
            docs = pdf[pdf["kind"] == "schema"]
            for n, body in zip(docs["lsn"], docs["body"], strict=True):
                if at is None or n >= at:
                    known, at = set(filter(None, body.split(","))), int(n)
            rows = pdf[pdf["kind"] == "row"]
            held += [[int(n), c, b] for n, c, b in zip(rows["lsn"], rows["columns"], rows["body"], strict=True)]
        held.sort(key=lambda x: x[0])
        ready, waiting = [], []
        for n, names, body in held:
            columns = [c for c in (names or "").split(",") if c]
            kept = [c for c in columns if c in known]
            if at is not None and (len(kept) == len(columns) or n < at):
                ready.append((n, ",".join(kept), body))
            else:
                waiting.append(json.dumps([n, names, body]))
        state.update((sorted(known), at, waiting))
        if ready:
            lsns, names, bodies = zip(*ready, strict=True)
            yield pd.DataFrame({"table": [key[0]] * len(ready), "lsn": lsns, "columns": names, "body": bodies})

    return dealt.groupBy("table", "__shard").applyInPandasWithState(step, "table string, lsn long, columns string, body string", "known array<string>, at long, held array<string>", "append", GroupStateTimeout.NoTimeout)


def answered(writes: DataFrame, verdicts: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Stream-stream outer join: writes with their verdict, or with none once the time for one is over."""
    w = writes.withWatermark("written", late).alias("w")
    v = verdicts.withWatermark("judged", late).alias("v")
    on = F.expr(f"w.msg_id = v.msg_id AND v.judged >= w.written AND v.judged <= w.written + interval {late}")
    return w.join(v, on, "left_outer").select("w.msg_id", "w.written", F.coalesce("v.status", F.lit("timed_out")).alias("status"))


class ReplicaSink:
    """foreachBatch sink: current rows of a replica as a base table and the changes since, all Parquet.

    A batch writes its own last rows per key and then a pointer, which names the tables that make up the replica; every
    `compact` batches they become a new base, so the replica is rewritten once in so many batches. A batch that comes
    again after a failure finds its number and is skipped, so the fold is applied once. Tables that neither the newest
    pointer nor the one before names are removed; readers of the one before are not cut off."""

    def __init__(self, path: str, key: list[str], order: list[str], compact: int = 16):
        self.path, self.key, self.order, self.compact = path.rstrip("/"), key, order, compact

    def _pointers(self, spark: SparkSession) -> list[int]:
        return sorted(int(n) for n in names_in(spark, f"{self.path}/pointer") if names_in(spark, f"{self.path}/pointer/{n}", "_SUCCESS"))

    def _tables(self, spark: SparkSession, batch: int) -> list[str]:
        return spark.read.schema("tables array<string>").json(f"{self.path}/pointer/{batch:020d}").first()[0]

    def pointer(self, spark: SparkSession) -> dict | None:
        known = self._pointers(spark)
        return {"batch": known[-1], "tables": self._tables(spark, known[-1])} if known else None

    def _folded(self, rows: DataFrame) -> DataFrame:
        """Deletes stay as rows: a late older write must not bring a deleted row back."""
        rest = [c for c in rows.columns if c not in self.key]
        top = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("last"))
        return top.select(*self.key, "last.*").select(*rows.columns)

    def _read(self, spark: SparkSession, tables: list[str]) -> DataFrame:
        parts = [spark.read.parquet(f"{self.path}/tables/{t}") for t in tables]
        return self._folded(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))

    def current(self, spark: SparkSession) -> DataFrame | None:
        at = self.pointer(spark)
        return self._read(spark, at["tables"]) if at else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = self.pointer(spark)
        if at and at["batch"] >= batch_id:
            return
        name = f"t-{batch_id}-{uuid.uuid4().hex[:8]}"
        self._folded(batch).write.parquet(f"{self.path}/tables/{name}")
        tables = [*(at["tables"] if at else []), name]
        if len(tables) > self.compact:
            base = f"base-{batch_id}-{uuid.uuid4().hex[:8]}"
            self._read(spark, tables).write.parquet(f"{self.path}/tables/{base}")
            tables = [base]
        spark.createDataFrame([(tables,)], "tables array<string>").coalesce(1).write.mode("overwrite").json(f"{self.path}/pointer/{batch_id:020d}")
        self._tidy(spark)

    def _tidy(self, spark: SparkSession) -> None:
        known = self._pointers(spark)
        for old in known[:-2]:
            remove(spark, f"{self.path}/pointer/{old:020d}")
        named = {t for b in known[-2:] for t in self._tables(spark, b)}
        for t in names_in(spark, f"{self.path}/tables"):
            if t not in named:
                remove(spark, f"{self.path}/tables/{t}")

    def live(self, spark: SparkSession) -> DataFrame | None:
        now = self.current(spark)
        return None if now is None else now.where("operation <> 'DELETE'")


class RequestQueue:
    """foreachBatch function: requests are handled one at a time, in the order of `seq`, and acknowledged on receipt.

    A mark under `path` is the acknowledgement, written before `handle(row)` is called: a batch that comes again skips what
    it had taken. A request that fails is not repeated; `failed(row, error)` reports it and the next one follows. The
    source bounds a batch (maxFilesPerTrigger), and rows come to the driver one by one."""

    def __init__(self, path: str, handle, failed=None):
        self.path, self.handle, self.failed = path.rstrip("/"), handle, failed

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = set(names_in(spark, f"{self.path}/{batch_id:020d}"))
        for row in batch.orderBy("seq").toLocalIterator():
            if str(row["seq"]) in taken:
                continue
            make_folder(spark, f"{self.path}/{batch_id:020d}/{row['seq']}")
            try:
                self.handle(row)
            except Exception as e:
                if self.failed is None:
                    raise
                self.failed(row, e)
        for old in names_in(spark, self.path):
            if old.isdigit() and int(old) < batch_id:
                remove(spark, f"{self.path}/{old}")


class MutationQueue:
    """foreachBatch function: writes are applied, and come again until they are, `most` times at most.

    `apply(df)` returns df (seq, delivered, ...) with `acked` and `permanent`. What is neither waits under `path` and joins
    the next batch with `delivered` one up; what is permanent, or was delivered `most` times, goes to `dead(df)` at once.
    The waiting rows of a batch are a table named by its number, so a batch that comes again finds what it had before;
    `apply` and `dead` are to be idempotent by message id."""

    def __init__(self, path: str, apply, dead, most: int = MAX_DELIVER):
        self.path, self.apply, self.dead, self.most = path.rstrip("/"), apply, dead, most

    def waiting(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """What waits, as of the last batch before `before`."""
        done = [int(n) for n in names_in(spark, self.path) if n.isdigit() and names_in(spark, f"{self.path}/{n}", "_SUCCESS")]
        known = [n for n in done if before is None or n < before]
        return spark.read.parquet(f"{self.path}/{max(known):020d}") if known else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = self.waiting(spark, batch_id)
        new = batch.withColumn("delivered", F.lit(1))
        rows = new if held is None else new.unionByName(held.withColumn("delivered", F.col("delivered") + 1))
        judged = written(self.apply(rows), "judged")
        over = F.col("permanent") | (F.col("delivered") >= self.most)
        self.dead(judged.where(~F.col("acked") & over).select(*rows.columns))
        judged.where(~F.col("acked") & ~over).select(*rows.columns).write.mode("overwrite").parquet(f"{self.path}/{batch_id:020d}")
        for old in sorted(int(n) for n in names_in(spark, self.path) if n.isdigit())[:-2]:
            remove(spark, f"{self.path}/{old:020d}")


def schemas_first(sink_schemas, sink_rows):
    """foreachBatch function: schema messages of a batch are written before its rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sink_schemas(batch.where("is_schema"), batch_id)
            sink_rows(batch.where("not is_schema"), batch_id)
        finally:
            batch.unpersist()

    return write


def backfilled(static: DataFrame, live: DataFrame) -> DataFrame:
    """Boot: what there is, then what comes."""
    return static.unionByName(live, allowMissingColumns=True)


def progress(query) -> dict:
    """Metrics of a running query: rows, rate, batch, lag of the source."""
    p = query.lastProgress or {}
    return {"batch": p.get("batchId"), "rows": p.get("numInputRows"), "rows_per_s": p.get("processedRowsPerSecond"), "state_rows": sum(s["numRowsTotal"] for s in p.get("stateOperators", []))}
