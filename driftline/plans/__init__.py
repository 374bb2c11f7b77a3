"""Registered queries. Importing this package registers all of them."""

from driftline.plans import catalog_queries, stream_queries, table_queries, write_queries  # noqa: F401
from driftline.plans.registry import ORACLES, QUERIES  # noqa: F401
