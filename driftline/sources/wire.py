"""Decoders of the binary log and of binary table copies, run over Arrow batches.

The formats are those of the public PostgreSQL documentation (logical replication messages, COPY BINARY).
"""

from __future__ import annotations

import struct
from datetime import UTC, date, datetime, timedelta
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.sources.tables import last_known

#: Type numbers.
OIDS = {
    "bool": 16, "bytea": 17, "int8": 20, "int2": 21, "int4": 23, "text": 25, "json": 114, "float4": 700, "float8": 701, "bpchar": 1042,
    "varchar": 1043, "date": 1082, "timestamp": 1114, "timestamptz": 1184, "numeric": 1700, "uuid": 2950, "jsonb": 3802,
}
#: Type numbers of arrays, with their elements' types.
ARRAYS = {1000: "bool", 1001: "bytea", 1005: "int2", 1007: "int4", 1009: "text", 1015: "varchar", 1016: "int8", 1021: "float4", 1022: "float8", 1115: "timestamp", 1182: "date", 1185: "timestamptz", 1231: "numeric", 2951: "uuid", 3807: "jsonb"}
NAMES = {v: k for k, v in OIDS.items()}
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)


class Refused(ValueError):
    """A value of a type that cannot be decoded; the table has to be suspended."""


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def num(self, kind: str):
        return struct.unpack(">" + kind, self.take(struct.calcsize(">" + kind)))[0]

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.take(end - self.at).decode()
        self.at += 1
        return out


def numeric_text(raw: bytes) -> str:
    """Exact decimal text of a binary numeric, unpadded beyond its display scale."""
    r = Reader(raw)
    count, weight, sign, scale = r.num("h"), r.num("h"), r.num("H"), r.num("h")
    special = {0xC000: "NaN", 0xD000: "Infinity", 0xF000: "-Infinity"}.get(sign)
    if special:
        return special
    groups = [r.num("h") for _ in range(count)]
    value = sum(g * 10 ** (4 * (count - 1 - i)) for i, g in enumerate(groups))
    shift = 4 * (weight - count + 1) + scale  # of the value, to an integer with `scale` decimals
    whole = value * 10**shift if shift >= 0 else value // 10**-shift
    digits = str(whole).rjust(scale + 1, "0")
    body = digits if scale == 0 else f"{digits[:-scale]}.{digits[-scale:]}"
    return ("-" if sign == 0x4000 and whole else "") + body


def array_value(raw: bytes):
    """(element type name, nested lists of element bytes; None for null)."""
    r = Reader(raw)
    dims, _, oid = r.num("i"), r.num("i"), r.num("I")
    shape = [(r.num("i"), r.num("i"))[0] for _ in range(dims)]

    def level(left: list[int]):
        if len(left) == 0:
            n = r.num("i")
            return None if n < 0 else r.take(n)
        return [level(left[1:]) for _ in range(left[0])]

    return oid, level(shape) if dims else []


def array_literal(raw: bytes) -> str:
    oid, value = array_value(raw)
    name = NAMES.get(oid)
    if name is None:
        raise Refused(f"array of type {oid}")

    def shown(x) -> str:
        if isinstance(x, list):
            return "{" + ",".join(map(shown, x)) + "}"
        if x is None:
            return "NULL"
        text = value_text(oid, x)
        if name == "bytea":
            return "\\x" + x.hex()
        if name == "bool":
            return "t" if x != b"\0" else "f"
        plain = name in ("int2", "int4", "int8", "float4", "float8", "numeric", "uuid", "date", "timestamp", "timestamptz")
        return text if plain else '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"' if name not in ("text", "varchar", "bpchar") or _needs_quotes(text) else text

    return shown(value)


def _needs_quotes(text: str) -> bool:
    return not text or text.upper() == "NULL" or any(c in ' ,{}"\\\t\n\r' for c in text)


def float_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def value_text(oid: int, raw: bytes, typtype: str = "b") -> str:
    """Text of a binary value. Types that are neither built in nor enums are refused."""
    name = NAMES.get(oid)
    if name == "bool":
        return "true" if raw != b"\0" else "false"
    if name in ("int2", "int4", "int8"):
        return str(int.from_bytes(raw, "big", signed=True))
    if name == "float4":
        return float_text(struct.unpack(">f", raw)[0])
    if name == "float8":
        return float_text(struct.unpack(">d", raw)[0])
    if name in ("text", "varchar", "bpchar", "json"):
        return raw.decode("utf-8", "replace")
    if name == "jsonb":
        return (raw[1:] if raw[:1] == b"\x01" else raw).decode("utf-8", "replace")
    if name == "bytea":
        return "\\x" + raw.hex()
    if name == "date":
        return (date(2000, 1, 1) + timedelta(days=int.from_bytes(raw, "big", signed=True))).isoformat()
    if name in ("timestamp", "timestamptz"):
        at = EPOCH + timedelta(microseconds=int.from_bytes(raw, "big", signed=True))
        return at.strftime("%Y-%m-%dT%H:%M:%S.%f") + ("Z" if name == "timestamptz" else "")
    if name == "uuid":
        h = raw.hex()
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    if name == "numeric":
        return numeric_text(raw)
    if oid in ARRAYS:
        return array_literal(raw)
    if typtype == "e":
        return raw.decode("utf-8", "replace")
    raise Refused(f"type {oid}")


def parse_frame(data: bytes) -> dict:
    """Stream frame: w (log data) or k (keep-alive)."""
    r = Reader(data)
    kind = r.take(1)
    if kind == b"w":
        start, end, us = r.num("Q"), r.num("Q"), r.num("q")
        return {"kind": "data", "wal_start": start, "wal_end": end, "ts": EPOCH + timedelta(microseconds=us), "payload": r.data[r.at :]}
    if kind == b"k":
        end, us = r.num("Q"), r.num("q")
        return {"kind": "keepalive", "wal_start": end, "wal_end": end, "ts": EPOCH + timedelta(microseconds=us), "payload": b""}
    raise ValueError(f"unknown frame {kind!r}")


def _tuple(r: Reader) -> list[tuple[str, bytes | None]]:
    """(state, bytes) per column: null, unchanged (keep what is there), text or binary."""
    states = {b"n": "null", b"u": "unchanged", b"t": "text", b"b": "binary"}
    out = []
    for _ in range(r.num("h")):
        state = states[r.take(1)]
        out.append((state, r.take(r.num("i")) if state in ("text", "binary") else None))
    return out


def parse_message(data: bytes) -> dict:
    """One logical replication message, by its first byte."""
    r = Reader(data)
    kind = r.take(1).decode()
    if kind == "B":
        return {"kind": "begin", "lsn": r.num("Q"), "ts": r.num("q"), "xid": r.num("I")}
    if kind == "C":
        r.take(1)
        return {"kind": "commit", "lsn": r.num("Q"), "end_lsn": r.num("Q"), "ts": r.num("q")}
    if kind == "O":
        return {"kind": "origin", "lsn": r.num("Q"), "name": r.text()}
    if kind == "Y":
        return {"kind": "type", "type_id": r.num("I"), "namespace": r.text(), "name": r.text()}
    if kind == "R":
        out = {"kind": "relation", "relation_id": r.num("I"), "namespace": r.text(), "name": r.text(), "replica_identity": r.take(1).decode()}
        return out | {"columns": [{"key": bool(r.num("B") & 1), "name": r.text(), "oid": r.num("I"), "typmod": r.num("i")} for _ in range(r.num("h"))]}
    if kind in "IUD":
        out = {"kind": {"I": "insert", "U": "update", "D": "delete"}[kind], "relation_id": r.num("I"), "old": None, "new": None}
        while r.at < len(r.data):
            part = r.take(1)
            out["new" if part == b"N" else "old"] = _tuple(r)
        return out
    if kind == "T":
        count, options = r.num("I"), r.num("B")
        return {"kind": "truncate", "cascade": bool(options & 1), "restart": bool(options & 2), "relation_ids": [r.num("I") for _ in range(count)]}
    raise ValueError(f"unknown message {kind!r}")


def tuple_maps(columns: list[dict], values: list | None) -> tuple[dict, list[str]]:
    """(name -> text or None, names of unchanged columns). A column count that differs from the relation's is fatal."""
    if values is None:
        return {}, []
    if len(values) != len(columns):
        raise ValueError("field count differs from the relation's")
    out, kept = {}, []
    for c, (state, raw) in zip(columns, values, strict=True):
        if state == "unchanged":
            kept.append(c["name"])
        else:
            out[c["name"]] = None if raw is None else raw.decode("utf-8", "replace") if state == "text" else value_text(c["oid"], raw, c.get("typtype", "b"))
    return out, kept


_COLUMN = pa.struct([("key", pa.bool_()), ("name", pa.string()), ("oid", pa.int64()), ("typmod", pa.int32())])
_TUPLE = pa.list_(pa.struct([("state", pa.string()), ("bytes", pa.binary())]))
_SQL_COLUMN, _SQL_TUPLE = "array<struct<key:boolean,name:string,oid:bigint,typmod:int>>", "array<struct<state:string,bytes:binary>>"


def parse_log(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Frames -> one typed row per message, beside the frame's own columns."""
    at, fields = frames.columns.index(payload), frames.schema
    names = ["kind_of", "xid", "commit_lsn", "relation_id", "namespace", "name", "replica_identity", "columns", "old_tuple", "new_tuple", "relation_ids"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(_COLUMN), _TUPLE, _TUPLE, pa.list_(pa.int64())]

    def run(batches):
        def cells(t):
            return None if t is None else [{"state": s, "bytes": b} for s, b in t]

        for batch in batches:
            parsed = [parse_message(x) for x in batch.column(at).to_pylist()]
            rows = [(m["kind"], m.get("xid"), m.get("lsn"), m.get("relation_id"), m.get("namespace"), m.get("name"), m.get("replica_identity"), m.get("columns"), cells(m.get("old")), cells(m.get("new")), m.get("relation_ids")) for m in parsed]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*fields.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return frames.mapInArrow(run, f"{own}, kind_of string, xid long, commit_lsn long, relation_id long, namespace string, name string, replica_identity string, columns {_SQL_COLUMN}, old_tuple {_SQL_TUPLE}, new_tuple {_SQL_TUPLE}, relation_ids array<bigint>")


def with_transactions(messages: DataFrame, order: list[str]) -> DataFrame:
    """Parsed messages with the xid and commit_lsn of the transaction that they stand in, carried from its BEGIN over its
    rows up to its COMMIT; both are null before the first BEGIN. `order` is the order of arrival, without ties: the stream
    sends one transaction after the other, so the last BEGIN is the row's own. One that is cut off by a reconnection is
    sent again under the same xid; its first rows go by their message ids."""
    begin = F.when(F.col("kind_of") == "begin", F.struct("xid", "commit_lsn"))
    carried = last_known(messages, order, begin, "__tx")
    return carried.withColumns({"xid": F.col("__tx.xid"), "commit_lsn": F.col("__tx.commit_lsn")}).drop("__tx")


def committed_rows(messages: DataFrame) -> DataFrame:
    """Row messages of transactions whose COMMIT arrived; `messages` as with_transactions gives them."""
    done = messages.where("kind_of = 'commit'").select("xid", "commit_lsn").distinct()
    return messages.where("kind_of in ('insert', 'update', 'delete', 'truncate')").join(done, ["xid", "commit_lsn"], "left_semi")


def relation_versions(messages: DataFrame, at: str) -> DataFrame:
    """(relation_id, name, columns, since, until): what each relation message says holds from it to the next one of its
    relation (until is null for the last). There is a row per change of a table and connection, not per row changed."""
    known = messages.where("kind_of = 'relation'").select("relation_id", "name", "columns", F.col(at).alias("since"))
    return known.withColumn("until", F.lead("since").over(Window.partitionBy("relation_id").orderBy("since")))


def decode_rows(changes: DataFrame, relations: DataFrame, at: str | None = None) -> DataFrame:
    """Row messages joined to their relation (an unknown relation drops the row) -> data, old, unchanged, refused.

    `relations` is the catalog's table dimension (relation_id, name, columns): Spark broadcasts it while it is small. With
    `at`, the rows' position, it has since and until too (relation_versions), and a row meets the version that held when
    it was written. A value that can't be decoded, or a field count other than the relation's, refuses the row: `refused`
    says why, and its table is to be suspended; other rows go on."""
    rows = changes.where("kind_of in ('insert', 'update', 'delete')").drop("namespace", "name", "replica_identity", "columns", "relation_ids")
    if at is None:
        joined = rows.join(relations.select("relation_id", "name", "columns"), "relation_id")
    else:
        r = relations.select(F.col("relation_id").alias("__id"), "name", "columns", F.col("since").alias("__since"), F.col("until").alias("__until"))
        held = (F.col("relation_id") == F.col("__id")) & (F.col(at) >= F.col("__since")) & (F.col("__until").isNull() | (F.col(at) < F.col("__until")))
        joined = rows.join(r, held).drop("__id", "__since", "__until")
    fields = joined.schema
    new, old, cols = (joined.columns.index(c) for c in ("new_tuple", "old_tuple", "columns"))

    def run(batches):
        def plain(t):
            return None if t is None else [(c["state"], c["bytes"]) for c in t]

        for batch in batches:
            out = []
            for n, o, c in zip(*(batch.column(i).to_pylist() for i in (new, old, cols)), strict=True):
                try:
                    (data, kept), (before, _) = tuple_maps(c, plain(n)), tuple_maps(c, plain(o))
                    out.append((list(data.items()), list(before.items()), kept, None))
                except ValueError as e:  # Refused among them
                    out.append((None, None, None, str(e)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            m = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, (m, m, pa.list_(pa.string()), pa.string()), strict=True))], names=[*fields.names, "data", "old", "unchanged", "refused"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return joined.mapInArrow(run, f"{own}, data map<string,string>, old map<string,string>, unchanged array<string>, refused string").drop("old_tuple", "new_tuple", "columns")


COPY_SIGNATURE = b"PGCOPY\n\xff\r\n\0"


def copy_rows(data: bytes, oids: list[int]):
    """Rows of a binary copy as text, one at a time; a field count other than the layout's is fatal."""
    r = Reader(data)
    if r.take(len(COPY_SIGNATURE)) != COPY_SIGNATURE:
        raise ValueError("no binary copy")
    r.take(4)
    r.take(r.num("i"))
    while (count := r.num("h")) != -1:
        if count != len(oids):
            raise ValueError("field count differs from the layout's")
        row = []
        for oid in oids:
            n = r.num("i")
            row.append(None if n < 0 else value_text(oid, r.take(n)))
        yield row


def parse_copy(data: bytes, oids: list[int]) -> list[list[str | None]]:
    return list(copy_rows(data, oids))


def read_copies(files: DataFrame, names: list[str], oids: list[int], content: str = "content", block: int = 4096) -> DataFrame:
    """Binary copies (spark.read.format("binaryFile")) -> rows of text columns, `block` at a time. A file is one value
    (2 GB at most), so writers end a copy's file after some hundred MB; files are read in parallel."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = copy_rows(data, oids)
                while part := list(islice(rows, block)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string()) for i in range(len(names))], names=names)

    return files.select(content).mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
