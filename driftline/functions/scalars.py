"""Scalar functions of the change-stream domain, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.model import WIRE_OVERHEAD

# --- log positions, time, rendering ------------------------------------------------------------------------------


def lsn_parse(text: Column, strict: bool = False) -> Column:
    """`HI/LO` in hexadecimal -> (HI << 32) | LO. Lenient: 0 for anything else; strict: an error."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    good = text.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    value = F.shiftleft(half(1), 32).bitwiseOR(half(2))
    bad = F.raise_error(F.concat(F.lit("bad log position: "), F.coalesce(text, F.lit("null")))).cast("long") if strict else F.lit(0).cast("long")
    return F.when(good, value).otherwise(bad)


def lsn_text(lsn: Column) -> Column:
    return F.concat_ws("/", F.hex(F.shiftright(lsn, 32)), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))


def pg_date(days: Column) -> Column:
    """Days since 2000-01-01 -> date."""
    return F.date_add(F.lit("2000-01-01").cast("date"), days)


def ts_text(ts: Column, aware: bool) -> Column:
    """ISO text with six digits; Z only for zone-aware types. Naive values are never moved."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z" if aware else ""))


def uuid_text(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(raw)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def bytea_text(raw: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(raw)))


def declared_scale(type_text: Column) -> Column:
    """Scale of numeric(p,s); null if none or not positive."""
    scale = F.nullif(F.regexp_extract(type_text, r"^(?:numeric|decimal)\(\s*\d+\s*,\s*(-?\d+)\s*\)$", 1), F.lit("")).cast("int")
    return F.when(scale > 0, scale)


def pad_numeric(text: Column, scale: Column) -> Column:
    """Zeros up to the declared scale; never truncates; NaN and infinities stay."""
    dot = F.instr(text, ".")
    digits = F.when(dot > 0, F.length(text) - dot).otherwise(0)
    lacking = F.greatest(F.lit(0), scale - digits)
    padded = F.concat(text, F.when((dot == 0) & (lacking > 0), ".").otherwise(""), F.repeat(F.lit("0"), lacking))
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$") & scale.isNotNull(), padded).otherwise(text)


def quoted_element(s: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), '"', r'\\"'), F.lit('"'))


def array_text(a: Column, kind: str, dims: int = 1) -> Column:
    """Array literal: {1,NULL,3}; text elements quoted and escaped; binary as \\x hex; nested braces for more dimensions."""
    if dims > 1:
        inner = lambda x: array_text(x, kind, dims - 1)
    elif kind == "text":
        inner = quoted_element
    elif kind == "binary":
        inner = bytea_text
    elif kind == "boolean":
        inner = lambda x: F.when(x, "t").when(~x, "f")
    else:
        inner = lambda x: x.cast("string")
    return F.concat(F.lit("{"), F.array_join(F.transform(a, lambda x: F.coalesce(inner(x), F.lit("NULL"))), ","), F.lit("}"))


def jsonb_text(s: Column) -> Column:
    """Drop a leading version byte or wrapping quotes."""
    return F.regexp_replace(F.regexp_replace(s, "^\u0001", ""), r'^"([\s\S]*)"$', "$1")


#: Source types that are not TEXT in SQLite.
SQLITE_TYPES = {
    "integer": "INTEGER", "int": "INTEGER", "int4": "INTEGER", "bigint": "INTEGER", "int8": "INTEGER", "smallint": "INTEGER", "int2": "INTEGER",
    "serial": "INTEGER", "serial4": "INTEGER", "bigserial": "INTEGER", "serial8": "INTEGER", "smallserial": "INTEGER", "serial2": "INTEGER",
    "boolean": "INTEGER", "bool": "INTEGER", "real": "REAL", "float4": "REAL", "double precision": "REAL", "float8": "REAL",
    "numeric": "TEXT", "decimal": "TEXT",
}
#: Spark's own names of types that the source calls otherwise.
SPARK_TYPES = {"tinyint": "smallint", "float": "real", "double": "double precision", "string": "text", "binary": "bytea", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone"}


def source_type(spark_type: str) -> str:
    """The source's name of a Spark type."""
    return SPARK_TYPES.get(spark_type, spark_type.replace("decimal(", "numeric("))


def sqlite_type(type_text: Column) -> Column:
    """Exact numerics are TEXT, never REAL; unknown types are TEXT."""
    table = F.create_map(*(F.lit(x) for kv in SQLITE_TYPES.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(F.trim(type_text))), F.lit("TEXT"))


def snapshot_text(c: Column, kind: str) -> Column:
    """Snapshot form: every field is text or null; booleans t and f."""
    if kind == "boolean":
        return F.when(c, "t").when(~c, "f")
    if kind == "binary":
        return F.decode(c, "UTF-8")
    if kind.startswith("timestamp"):
        return ts_text(c, kind == "timestamp")
    return c.cast("string")


def same_value(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def log_value(s: Column) -> Column:
    return F.when(F.length(s) > 50, F.concat(F.substring(s, 1, 47), F.lit("..."))).otherwise(s)


def row_bytes(variable: list[Column], fixed: int) -> Column:
    """Width of a row: bytes of text-like columns (0 for null), 24 for each fixed column and 24 for the row."""
    total = F.lit(24 + 24 * fixed).cast("long")
    for c in variable:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def wire_bytes(data: Column, table: Column, operation: Column, subject: Column) -> Column:
    return (F.octet_length(data) + F.octet_length(table) + F.octet_length(operation) + F.octet_length(subject) + WIRE_OVERHEAD).cast("long")


# --- versions, errors, subjects ----------------------------------------------------------------------------------


def clamp_version(version: Column, now: Column, slack_s: int = 5) -> Column:
    """A version may not run ahead of the arrival clock by more than the slack."""
    return F.least(version, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(slack_s)))


#: SQLSTATE classes that no retry mends.
PERMANENT_CLASSES = ("42", "23", "22", "3F", "0A")
#: Named errors that no retry mends.
PERMANENT_ERRORS = (
    "InvalidPayloadFormat", "MissingTable", "InvalidTableFormat", "MissingOperation", "InvalidOperationFormat", "MissingHLC", "InvalidHLCFormat",
    "MissingPrimaryKey", "InvalidPrimaryKeyFormat", "MissingData", "InvalidDataFormat", "UnsupportedPayloadType", "MalformedSubject", "UnknownOperation",
    "ForbiddenTable", "UnknownColumn", "RowTooLargeToReplicate", "MissingVersion", "NoVersionColumn", "NoTombstoneColumn", "NoPrimaryKey", "DbAllocatedKey",
)
#: Those of them that an operator has to mend.
OPERATOR_ERRORS = ("NoVersionColumn", "NoTombstoneColumn", "NoPrimaryKey", "DbAllocatedKey")
#: This engine's own permanent error: an update that would move its row to another key.
OWN_ERRORS = ("PrimaryKeyReassigned",)


def sqlstate_permanent(state: Column) -> Column:
    return F.coalesce(F.substring(state, 1, 2).isin(*PERMANENT_CLASSES), F.lit(False))


def error_permanent(name: Column) -> Column:
    """No retry mends it; operator faults are permanent, too."""
    return F.coalesce(name.isin(*PERMANENT_ERRORS, *OWN_ERRORS), F.lit(False))


def error_class(name: Column) -> Column:
    return F.when(name.isin(*OPERATOR_ERRORS), "operator").when(error_permanent(name), "permanent").otherwise("transient")


def token_valid(s: Column) -> Column:
    """1 to 128 bytes without dots, wildcards, white space or control characters."""
    return F.coalesce(F.octet_length(s).between(1, 128) & ~s.rlike(r"[.*>\x00-\x20\x7F]"), F.lit(False))


def token_clean(s: Column) -> Column:
    return F.regexp_replace(s, r"[.*>\s]", "-")


def subject_parse(subject: Column, prefix: str = "mutations") -> Column:
    """prefix.principal.table.operation, exactly four tokens -> struct; else null."""
    t = F.split(subject, r"\.", -1)
    good = (F.size(t) == 4) & (F.get(t, F.lit(0)) == prefix) & (F.get(t, F.lit(3)).isin("insert", "update", "delete")) & (F.get(t, F.lit(1)) != "") & (F.get(t, F.lit(2)) != "")
    return F.when(good, F.struct(F.get(t, F.lit(1)).alias("principal"), F.get(t, F.lit(2)).alias("table"), F.get(t, F.lit(3)).alias("operation")))


def subject_of(table: Column, operation: Column, tenant: Column | None = None, suffix: Column | None = None, prefix: str = "cdc") -> Column:
    """cdc[.tenant].table.op[.suffix]; absent parts leave no dot."""
    parts = [F.lit(prefix), *([tenant] if tenant is not None else []), table, F.lower(operation), *([suffix] if suffix is not None else [])]
    return F.concat_ws(".", *parts)


def message_id(lsn: Column, table: Column, operation: Column, ordinal: Column | None = None) -> Column:
    """hex(lsn)-table-op, and an ordinal that keeps rows of one log position apart."""
    return F.concat_ws("-", F.lower(F.hex(lsn)), table, F.lower(operation), *([ordinal.cast("string")] if ordinal is not None else []))


def payload_text(c: Column, kind: str) -> Column:
    """Payload value as text; kinds other than scalars are errors (null here)."""
    return c.cast("string") if kind in ("boolean", "int", "bigint", "float", "double", "string", "smallint") else F.lit(None).cast("string")


def error_text(s: Column) -> Column:
    """First line, quotes and backslashes as ', tabs as blanks."""
    return F.translate(F.element_at(F.split(s, r"\r?\n"), 1), '"\\\t', "'' ")


#: Prefixes of creation stamps, types that order versions, and the precision under which ties are common.
CREATION_PREFIXES, VERSION_TYPES, LEAST_PRECISION = ("created", "inserted"), ("timestamp", "timestamptz", "int8", "int4"), 6


def version_verdict(name: Column, type_name: Column, precision: Column, not_null: Column) -> Column:
    """absent, creation_column, wrong_type or usable, with +naive, +coarse and +nullable as they apply. type_name is the
    source's internal one (null: no such column); precision: of a timestamp, -1 if none is declared."""
    stamp = type_name.isin("timestamp", "timestamptz")
    flags = {"+naive": type_name == "timestamp", "+coarse": stamp & (precision >= 0) & (precision < LEAST_PRECISION), "+nullable": ~not_null}
    usable = F.concat(F.lit("usable"), *(F.when(c, k).otherwise("") for k, c in flags.items()))
    creation = F.lit(False)
    for p in CREATION_PREFIXES:
        creation = creation | name.startswith(p)
    return F.when(type_name.isNull(), "absent").when(creation, "creation_column").when(~type_name.isin(*VERSION_TYPES), "wrong_type").otherwise(usable)


def type_verdict(oid_known: Column, typtype: Column) -> Column:
    return F.when(oid_known, "decode").when(typtype == "e", "text_passthrough").otherwise("refuse")


def json_object(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())))


def next_stamp(last: Column, now_ms: Column) -> Column:
    """A version stamp that never repeats: the clock, or one more than the last."""
    return F.greatest(now_ms, F.coalesce(last, F.lit(-1)) + 1)


def ceil_to(n: Column, step: int) -> Column:
    return (F.ceil(n / step) * step).cast("long")


def clamped(n: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), n))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit((1 << 63) - 1))
