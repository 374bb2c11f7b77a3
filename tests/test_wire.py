"""Decoders against bytes built here, scalars and grammar against literal values."""

import struct

import pytest
from pyspark.sql import functions as F

from driftline.functions import config, scalars
from driftline.operators import change, replica, snapshot
from driftline.sources import tables, wire


def numeric(digits, weight, sign, scale):
    return struct.pack(f">hhHh{len(digits)}h", len(digits), weight, sign, scale, *digits)


@pytest.mark.parametrize(("raw", "text"), [
    (numeric([], 0, 0, 0), "0"), (numeric([123, 4567, 9101, 1000], 1, 0, 8), "1234567.91011000"), (numeric([1, 2345], 1, 0, 0), "12345"),
    (numeric([42], -1, 0x4000, 4), "-0.0042"), (numeric([], 0, 0xC000, 0), "NaN"), (numeric([], 0, 0xD000, 0), "Infinity"), (numeric([], 0, 0xF000, 0), "-Infinity"),
])
def test_numeric(raw, text):
    assert wire.numeric_text(raw) == text


def array(oid, dims, elements):
    head = struct.pack(">iiI", len(dims), 0, oid) + b"".join(struct.pack(">ii", d, 1) for d in dims)
    return head + b"".join(struct.pack(">i", -1) if e is None else struct.pack(">i", len(e)) + e for e in elements)


def ints(*xs):
    return [None if x is None else struct.pack(">i", x) for x in xs]


@pytest.mark.parametrize(("raw", "text"), [
    (array(23, [4], ints(1, 2, 3, 4)), "{1,2,3,4}"), (array(23, [2, 2], ints(1, 2, 3, 4)), "{{1,2},{3,4}}"),
    (array(23, [2, 2, 2], ints(*range(1, 9))), "{{{1,2},{3,4}},{{5,6},{7,8}}}"), (array(23, [3], ints(1, None, 3)), "{1,NULL,3}"),
    (array(25, [3], [b"a", b"b c", b'd"e']), '{a,"b c","d\\"e"}'), (array(17, [2], [b"\xde\xad\xbe\xef", b"\x01\x02\x03\x04"]), "{\\xdeadbeef,\\x01020304}"),
    (array(701, [3], [struct.pack(">d", x) for x in (1.5, 2.25, 3.75)]), "{1.5,2.25,3.75}"), (struct.pack(">iiI", 0, 0, 23), "{}"), (array(16, [2], [b"\1", b"\0"]), "{t,f}"),
    (array(1700, [1], [numeric([1, 5000], 0, 0, 1)]), "{1.5}"),
])
def test_array(raw, text):
    assert wire.array_literal(raw) == text


def test_values():
    us = struct.pack(">q", (9430 * 86400 + 36000) * 1_000_000)
    assert wire.value_text(1114, us) == "2025-10-26T10:00:00.000000"
    assert wire.value_text(1184, us) == "2025-10-26T10:00:00.000000Z"
    assert wire.value_text(1082, struct.pack(">i", 0)) == "2000-01-01"
    assert wire.value_text(2950, bytes(range(16))) == "00010203-0405-0607-0809-0a0b0c0d0e0f"
    assert wire.value_text(3802, b'\x01{"a":1}') == '{"a":1}'
    assert wire.value_text(99999, b"ok", "e") == "ok"
    with pytest.raises(wire.Refused):
        wire.value_text(99999, b"x")


def text(s):
    return s.encode() + b"\0"


def relation():
    cols = b"".join(struct.pack(">B", k) + text(n) + struct.pack(">Ii", o, -1) for k, n, o in ((1, "id", 23), (0, "name", 25)))
    return b"R" + struct.pack(">I", 7) + text("public") + text("users") + b"d" + struct.pack(">h", 2) + cols


def row(*cells):
    return struct.pack(">h", len(cells)) + b"".join(c if len(c) == 1 else c[:1] + struct.pack(">i", len(c) - 1) + c[1:] for c in cells)


MESSAGES = [
    b"B" + struct.pack(">QqI", 500, 0, 9), relation(), b"I" + struct.pack(">I", 7) + b"N" + row(b"b" + struct.pack(">i", 5), b"tann"),
    b"U" + struct.pack(">I", 7) + b"K" + row(b"t4", b"n") + b"N" + row(b"t5", b"u"), b"D" + struct.pack(">I", 7) + b"K" + row(b"t5", b"n"),
    b"T" + struct.pack(">IBI", 1, 1, 7), b"C" + b"\0" + struct.pack(">QQq", 500, 510, 0), b"O" + struct.pack(">Q", 1) + text("o"), b"Y" + struct.pack(">I", 99) + text("public") + text("mood"),
]


def test_log(spark):
    assert wire.parse_frame(b"w" + struct.pack(">QQq", 1, 2, 0) + b"xyz")["payload"] == b"xyz"
    assert wire.parse_frame(b"k" + struct.pack(">QqB", 3, 0, 1))["kind"] == "keepalive"
    frames = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(MESSAGES)], "lsn long, payload binary")
    log = wire.parse_log(frames).cache()
    assert [r.kind_of for r in log.orderBy("lsn").collect()] == ["begin", "relation", "insert", "update", "delete", "truncate", "commit", "origin", "type"]
    rows = wire.decode_rows(log, log.where("kind_of = 'relation'")).orderBy("lsn").collect()
    assert [(r.kind_of, r.data, r.old, r.unchanged) for r in rows] == [("insert", {"id": "5", "name": "ann"}, {}, []), ("update", {"id": "5"}, {"id": "4", "name": None}, ["name"]), ("delete", {}, {"id": "5", "name": None}, [])]
    with pytest.raises(ValueError):
        wire.tuple_maps([{"name": "a", "oid": 23}], [])


def altered():
    cols = b"".join(struct.pack(">B", k) + text(n) + struct.pack(">Ii", o, -1) for k, n, o in ((1, "id", 23), (0, "name", 25), (0, "age", 23)))
    return b"R" + struct.pack(">I", 7) + text("public") + text("users") + b"d" + struct.pack(">h", 3) + cols


def test_log_to_transactions(spark):
    """Frames -> messages -> transactions -> rows by the relation of their time."""
    insert = lambda *cells: b"I" + struct.pack(">I", 7) + b"N" + row(*cells)
    begin = lambda xid: b"B" + struct.pack(">QqI", 100 * xid, 0, xid)
    commit = lambda xid: b"C\0" + struct.pack(">QQq", 100 * xid, 100 * xid + 1, 0)
    stream = [begin(1), relation(), *(insert(b"t%d" % i, b"tx") for i in range(40)), commit(1), begin(2), altered(), insert(b"t90", b"ty", b"t7"), insert(b"t91", b"ty"), commit(2), begin(3), insert(b"t99", b"tz", b"n")]
    frames = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(stream)], "n long, payload binary").repartition(5)
    log = wire.with_transactions(wire.parse_log(frames), ["n"])
    assert {(r.n, r.xid, r.commit_lsn) for r in log.collect()} == {(i, x, 100 * x) for i in range(len(stream)) for x in [1 if i < 43 else 2 if i < 48 else 3]}
    rows = wire.decode_rows(wire.committed_rows(log), wire.relation_versions(log, "n"), "n").orderBy("n").collect()
    assert [(r.xid, r.data and r.data["id"], r.refused is None) for r in rows] == [*((1, str(i), True) for i in range(40)), (2, "90", True), (2, None, False)]
    assert rows[40].data == {"id": "90", "name": "y", "age": "7"} and "field count" in rows[41].refused


def test_messages_before_the_first_begin_have_no_transaction(spark):
    frames = spark.createDataFrame([(0, bytearray(relation()))], "n long, payload binary")
    assert [tuple(r) for r in wire.with_transactions(wire.parse_log(frames), ["n"]).select("xid", "commit_lsn").collect()] == [(None, None)]
    assert wire.with_transactions(wire.parse_log(frames.limit(0)), ["n"]).count() == 0


def test_copies_are_read_in_blocks(spark):
    body = b"".join(struct.pack(">hi", 1, 4) + struct.pack(">i", i) for i in range(1000))
    data = wire.COPY_SIGNATURE + struct.pack(">ii", 0, 0) + body + struct.pack(">h", -1)
    got = wire.read_copies(spark.createDataFrame([(bytearray(data),)], "content binary"), ["a"], [23], block=64)
    assert [r.a for r in got.collect()] == [str(i) for i in range(1000)]


def test_copy(spark, tmp_path):
    field = lambda b: struct.pack(">i", -1) if b is None else struct.pack(">i", len(b)) + b
    data = wire.COPY_SIGNATURE + struct.pack(">ii", 0, 0) + b"".join(struct.pack(">h", 2) + field(struct.pack(">i", i)) + field(None if i else b"x") for i in range(2)) + struct.pack(">h", -1)
    (tmp_path / "a.bin").write_bytes(data)
    got = wire.read_copies(spark.read.format("binaryFile").load(str(tmp_path)), ["id", "t"], [23, 25]).collect()
    assert [tuple(r) for r in got] == [("0", "x"), ("1", None)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    pad = lambda t, k: scalars.pad_numeric(F.lit(t), scalars.declared_scale(F.lit(k)))
    assert one(spark, pad("0.1000", "numeric(20,8)"), pad("NaN", "numeric(20,8)"), pad("1.123456789", "numeric(20,2)"), pad("5", "numeric(10)"), pad("5", "numeric(10,2)")) == ("0.10000000", "NaN", "1.123456789", "5", "5.00")
    tokens = [F.lit(t) for t in ("ok", "a.b", "a*", "a>", "a b", "", "x" * 129, "x" * 128)]
    assert one(spark, *(scalars.token_valid(t) for t in tokens)) == (True, False, False, False, False, False, False, True)
    assert one(spark, scalars.lsn_parse(F.lit("16/B374D848")), scalars.lsn_parse(F.lit("x")), scalars.lsn_text(F.lit(0x16B374D848))) == (0x16B374D848, 0, "16/B374D848")
    assert one(spark, scalars.array_text(F.array(F.lit("a"), F.lit('d"e'), F.lit(None)), "text")) == ('{"a","d\\"e",NULL}',)
    assert one(spark, scalars.jsonb_text(F.lit("\x01{}")), scalars.jsonb_text(F.lit('"{}"'))) == ("{}", "{}")
    assert one(spark, scalars.type_verdict(F.lit(True), F.lit("b")), scalars.type_verdict(F.lit(False), F.lit("e")), scalars.type_verdict(F.lit(False), F.lit("c"))) == ("decode", "text_passthrough", "refuse")
    assert one(spark, scalars.saturating_add(F.lit((1 << 63) - 1), F.lit(1)), scalars.next_stamp(F.lit(9), F.lit(5)), scalars.payload_text(F.lit(True), "boolean")) == ((1 << 63) - 1, 10, "true")
    with pytest.raises(Exception, match="bad log position"):
        one(spark, scalars.lsn_parse(F.lit("x"), strict=True))


def test_config():
    assert config.parse_rules("a:x,y; b:z") == {"a": ["x", "y"], "b": ["z"]}
    for bad in ("a", "a:", "a:x;a:y", "a:x,x"):
        with pytest.raises(ValueError):
            config.parse_rules(bad)
    assert config.render_pattern("snap.{[t]s}.{[n]s}", t="a", n="1") == "snap.a.1"
    for bad in ({"t": "a"}, {"t": "a", "n": "1", "z": ""}):
        with pytest.raises(KeyError):
            config.render_pattern("snap.{[t]s}.{[n]s}", **bad)
    assert config.keyset_predicate(["a"], [5]) == "`a` > 5"
    assert config.keyset_predicate(["a", "b"], [1, "x'"]) == "`a` >= 1 AND ((`a` > 1) OR (`a` = 1 AND `b` > 'x\\''))"
    assert config.keyset_predicate(["a"], None) == "1=1"
    assert config.keyset_predicate(["a"], [b"\xde"]) == "`a` > X'de'"
    assert config.shrink_rows(100, 10, 50, 2) == 1 and config.rows_per_chunk(1000, 10, 50, 60) == 60
    assert config.role_from_url("postgres://app:x@h/db") == "app"
    t = config.load_topology('{"streams": {"s": {"subjects": ["a"]}}, "buckets": {}}')
    assert config.missing_streams(t, ["s", "z"]) == ["z"]
    for bad in ("[", "{}", '{"streams": {"s": {}}, "buckets": {}}'):
        with pytest.raises(ValueError):
            config.load_topology(bad)


def test_keyset_reaches_the_scan(spark):
    plan = tables.page(tables.scan(spark, "/root/testdata/sf0.001", "conversations"), ["conv_id", "turn"], [5, 1], 3)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(conv_id,5)" in plan


def test_pairs_and_chunks(spark):
    rows = spark.createDataFrame([("UPDATE", {"s": "a"}, {"s": "b"}, []), ("UPDATE", {"s": "a"}, {}, ["s"]), ("INSERT", {}, {"s": "b"}, [])], "operation string, old map<string,string>, data map<string,string>, unchanged array<string>")
    assert [r["class"] for r in change.transitions_of_pairs(rows, ["s"]).collect()] == ["transition", "data", None]
    sized = spark.range(100).select("id", (F.col("id") % 7 * 10 + 1).alias("size"))
    packed = snapshot.packed_chunks(sized, ["id"], "size", 100)
    assert all(r["t"] <= 100 or r["n"] == 1 for r in packed.groupBy("chunk").agg(F.sum("size").alias("t"), F.count("*").alias("n")).collect())
    assert [r.id for r in packed.orderBy("chunk", "id").collect()] == list(range(100))
    chunks = spark.createDataFrame([(0, [["1", "a"], ["2", None]])], "chunk int, rows array<array<string>>")
    assert [r.data for r in tables.replay_chunks(chunks, ["id", "v"]).collect()] == [{"id": "1", "v": "a"}, {"id": "2", "v": None}]


def test_snapshot_and_changes_equal_the_final_state(spark):
    events = spark.createDataFrame([(k, n, "UPDATE" if n > 1 else "INSERT", f"{k}-{n}") for k in range(5) for n in range(1, 9)] + [(3, 9, "DELETE", None)], "pk long, lsn long, operation string, v string")
    final = {(r.pk, r.v) for r in replica.latest_rows(events, ["pk"], ["lsn"]).collect()}
    for x in range(1, 10):
        base = replica.latest_rows(events.where(f"lsn < {x}"), ["pk"], ["lsn"]).withColumn("lsn", F.lit(x).cast("long")).drop("operation")
        assert {(r.pk, r.v) for r in replica.combined(base, events.where(f"lsn >= {x}"), ["pk"]).collect()} == final


def test_packed():
    from driftline.operators.catalog import packed

    cases = {b"\xc0": None, b"\xc3": True, b"\x05": 5, b"\xff": -1, b"\xd3" + struct.pack(">q", 1000): 1000, b"\xcb" + struct.pack(">d", 1.5): 1.5, b"\xa1a": "a", b"\x81\xa1k\x92\x01\xc0": {"k": [1, None]}, b"\xc6\0\0\0\x01z": b"z"}
    assert all(packed(v) == raw for raw, v in cases.items())
