"""Driver-side text: rule grammar, subject patterns, topology, identifiers, keyset predicates."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit


def parse_rules(text: str) -> dict[str, list[str]]:
    """`table:col,col;table:col` -> columns by table. Blank parts, repeats and bad names are errors."""
    out: dict[str, list[str]] = {}
    for part in filter(None, map(str.strip, text.split(";"))):
        table, sep, cols = part.partition(":")
        names = [c.strip() for c in cols.split(",")]
        if not sep or not table.strip() or not all(re.fullmatch(r"[A-Za-z_]\w*", c) for c in names):
            raise ValueError(f"bad rule: {part!r}")
        if table.strip() in out or len(set(names)) != len(names):
            raise ValueError(f"repeated name in rule: {part!r}")
        out[table.strip()] = names
    return out


def render_pattern(pattern: str, **args: str) -> str:
    """`a.{[name]s}` with named arguments; unknown and unused ones are errors."""
    used = set(re.findall(r"\{\[(\w+)\]s\}", pattern))
    if used - set(args):
        raise KeyError(f"no value for {sorted(used - set(args))}")
    if set(args) - used:
        raise KeyError(f"unused: {sorted(set(args) - used)}")
    return re.sub(r"\{\[(\w+)\]s\}", lambda m: args[m[1]], pattern)


@dataclass(frozen=True)
class Topology:
    streams: dict[str, dict] = field(default_factory=dict)
    buckets: dict[str, str] = field(default_factory=dict)
    subjects: dict[str, str] = field(default_factory=dict)


def load_topology(text: str) -> Topology:
    """Sections are checked by name, so that an error says what is wrong where."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ValueError(f"topology: not JSON ({e})") from e
    for section in ("streams", "buckets"):
        if not isinstance(raw.get(section), dict):
            raise ValueError(f"topology: section {section!r} is missing or no object")
    for name, stream in raw["streams"].items():
        if not isinstance(stream, dict) or not stream.get("subjects"):
            raise ValueError(f"topology: stream {name!r} has no subjects")
    return Topology(raw["streams"], raw["buckets"], raw.get("subjects", {}))


def missing_streams(topology: Topology, tenants: list[str]) -> list[str]:
    """Declared tenants without a stream of their own."""
    return sorted(t for t in tenants if t not in topology.streams)


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_literal(value) -> str:
    if isinstance(value, bool | int | float):
        return str(value).lower()
    if isinstance(value, bytes):
        return "X'" + value.hex() + "'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyset_predicate(keys: list[str], after: list | None) -> str:
    """Rows after a key, in the order of the key; expanded, with a leading bound that a scan can push down."""
    if after is None:
        return "1=1"
    q, v = [quote_ident(k) for k in keys], [quote_literal(x) for x in after]
    arms = [" AND ".join([*(f"{q[j]} = {v[j]}" for j in range(i)), f"{q[i]} > {v[i]}"]) for i in range(len(q))]
    return arms[0] if len(q) == 1 else f"{q[0]} >= {v[0]} AND ({' OR '.join(f'({a})' for a in arms)})"


def role_from_url(url: str) -> str | None:
    return urlsplit(url).username


def snapshot_id(epoch_s: int, nonce: int) -> str:
    """Caller's clock and nonce: reruns agree."""
    return f"snap-{epoch_s}-{nonce & 0xFFFF:04x}"


def shrink_rows(budget: int, per_row: float, fit: int, current: int) -> int:
    """Rows of the next try after a chunk came out too large: fewer than now, at least one."""
    return max(1, min(int(budget / max(per_row, 1) * 9 // 10), fit, current - 1))


def rows_per_chunk(budget: int, average: float, ceiling: int, current: int = 1) -> int:
    """Adaptive row count: only ever raised."""
    return max(current, max(1, min(ceiling, int(budget / 5 * 4 / max(average, 1)))))
