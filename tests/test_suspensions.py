"""Suspended tables on made-up logs."""

import random
import time

from pyspark.sql import functions as F

from driftline.operators import guards


def test_each_event_against_each_interval(spark):
    r = random.Random(5)
    spans = [(r.choice("abc"), a, r.choice([a + r.randrange(-3, 9), a + r.randrange(60)])) for a in (r.randrange(400) for _ in range(40))]
    spans += [("a", 390, None), ("b", None, 50), ("b", None, None), ("c", 7, 7), (None, 0, 400), (None, 0, None), ("gone", 0, None)]
    rows = [(i, r.choice("abcd"), r.randrange(420)) for i in range(900)] + [(900, None, 5), (901, "a", None), (902, None, None), (903, "a", 390), (903, "a", 390), (904, "a", 389)]
    events = spark.createDataFrame(rows, "seq long, table string, lsn long")
    got = guards.suspended(events.repartition(5), spark.createDataFrame(spans, "table string, suspend_lsn long, resume_lsn long"))
    assert got.dtypes == events.dtypes  # columns stay in place
    lost = lambda t, n: t is not None and n is not None and any(t == s and a is not None and a <= n and (b is None or n < b) for s, a, b in spans)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(x) for x in rows if not lost(*x[1:]))
    none = spark.createDataFrame([], "table string, suspend_lsn long, resume_lsn long")
    assert guards.suspended(events, none).count() == len(rows)


def test_events_are_not_compared_with_each_interval(spark):
    n = 160_000  # of one table, with 40,000 intervals: 6.4 billion comparisons would take minutes
    log = spark.range(n).select(F.col("id").alias("seq"), F.lit("hot").alias("table"), (F.col("id") * 16).alias("lsn"))
    ddl = log.where("seq % 2 = 0").select("table", "lsn", (F.col("seq") % 4 != 0).alias("ok"))
    began = time.monotonic()
    got = guards.suspended(log, guards.suspensions(ddl)).agg(F.count("*"), F.sum("seq"), F.sum((F.col("seq") % 4 < 2).cast("int"))).first()
    assert tuple(got) == (n // 2, sum(i for i in range(n) if i % 4 >= 2), 0)
    assert time.monotonic() - began < 60
