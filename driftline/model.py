"""The data model: schemas of change events, mutations, verdicts, schema documents; table specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Table names that are bookkeeping and never data.
INTERNAL_TABLES = ("ddl_events", "gc_watermark", "principal_tenants", "schema_migrations")
#: Wire words of refusals.
REFUSALS = ("no_primary_key", "unsupported_column_type", "row_too_large", "no_tenant_column", "tenant_not_in_replica_identity")
#: Batch limits (events, milliseconds, bytes), wire overhead, clock slack and delivery limits.
BATCH_EVENTS, BATCH_MS, BATCH_BYTES = 5000, 500, 256 * 1024
WIRE_OVERHEAD, CLOCK_SLACK_S, MAX_DELIVER = 256, 5, 15
MUTATION_TIMEOUT_MS = 15 * 1000 + 500 + 2000

_map = T.MapType(T.StringType(), T.StringType())


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "map": _map, "strings": T.ArrayType(T.StringType()), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampNTZType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in text.split())])


FRAME = _schema("kind:string wal_start:long wal_end:long ts:timestamp payload:binary")
EVENT = _schema("seq:long lsn:long xid:long commit_lsn:long table:string operation:string subject:string msg_id:string relation_id:int tenant:string data:map old:map unchanged:strings")
MUTATION = _schema("seq:long principal:string table:string operation:string msg_id:string key:map data:map version:string client_id:string bytes:long delivered:int")
VERDICT = _schema("seq:long msg_id:string status:string reason:string sqlstate:string detail:string version:string")
SCHEMA_DOC = _schema("table:string pk_columns:strings replica_identity:string version_column:string tombstone_column:string tenant_column:string max_row_bytes:long mutation_timeout_ms:long dropped:boolean suspended:boolean reason:string lsn:long").add(
    T.StructField("columns", T.ArrayType(_schema("name:string type:string sqlite_type:string required:boolean")))
)


@dataclass(frozen=True)
class TableSpec:
    """What the write path knows of a table. `epoch` grows with every catalog change."""

    name: str
    pk: tuple[str, ...]
    columns: tuple[str, ...]
    version: str = "updated_at"
    client: str | None = None
    tombstone: str | None = None
    tenant: str | None = None
    version_is_time: bool = True
    epoch: int = 0


class SpecRegistry:
    """Specifications by table, resolved again when the catalog epoch has moved (once a micro-batch)."""

    def __init__(self, load):
        self._load, self._epoch, self._specs = load, None, {}

    def get(self, epoch: int) -> dict[str, TableSpec]:
        if epoch != self._epoch:
            self._specs, self._epoch = {s.name: s for s in self._load()}, epoch
        return self._specs
