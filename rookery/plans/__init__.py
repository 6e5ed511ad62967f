"""Registered queries with their SQL twins, and the maintenance job."""

from __future__ import annotations

import importlib
from types import ModuleType

_GROUPS = (
    "rule_queries",
    "feed_queries",
    "ingest_queries",
    "identity_queries",
    "retention_queries",
    "replication_queries",
    "state_queries",
    "stream_queries",
)


def load() -> ModuleType:
    """Import every query group and return the filled catalog."""
    for name in _GROUPS:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.catalog")
