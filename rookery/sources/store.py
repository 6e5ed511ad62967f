"""Versioned Parquet tables: data first, pointer last, readers resolve once.

A version of a table is a list of immutable folders. Replacing writes one new
folder; appending writes a folder of the new rows and keeps the others, so a
small delivery does not rewrite a large table. A writer that dies before its
pointer row leaves the old version in force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINTER = "name string, version long, signature string, paths array<string>"


class Store:
    """One writer at a time. Pointers are resolved once; ``refresh`` looks again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._found: dict[str, tuple[int, str | None, list[str]]] = {}
        self._schemas: dict[str, T.StructType] = {}
        self.refresh()

    def refresh(self) -> None:
        """Resolve the newest version of every table, one row per table."""
        try:
            pointers = self.spark.read.schema(_POINTER).parquet(f"{self.root}/_pointer")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # nothing published yet
        newest = pointers.groupBy("name").agg(
            F.max_by(F.struct("version", "signature", "paths"), "version").alias("p")
        )
        self._found = {r["name"]: tuple(r["p"]) for r in newest.collect()}
        self._schemas.clear()

    def current(self, name: str) -> tuple[int, str | None, list[str]] | None:
        """(version, signature, folders) in force."""
        return self._found.get(name)

    def read(self, name: str) -> DataFrame | None:
        found = self.current(name)
        if found is None:
            return None
        schema = self._schemas.get(name)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*found[2])

    def publish(
        self,
        replace: Mapping[str, DataFrame] | None = None,
        append: Mapping[str, DataFrame] | None = None,
        signature: str | None = None,
    ) -> None:
        """Write all tables to new folders, then move all pointers in one append."""
        rows, schemas = [], {}
        for tables, keep in ((replace or {}, False), (append or {}, True)):
            for name, df in tables.items():
                version, _, paths = self.current(name) or (0, None, [])
                path = f"{self.root}/{name}/v{version + 1}-{uuid.uuid4().hex[:8]}"
                df.write.parquet(path)
                rows.append((name, version + 1, signature, [*paths, path] if keep else [path]))
                schemas[name] = df.schema
        pointer = self.spark.createDataFrame(rows, _POINTER).coalesce(1)
        pointer.write.mode("append").parquet(f"{self.root}/_pointer")
        self._found |= {name: (version, stamp, paths) for name, version, stamp, paths in rows}
        self._schemas |= schemas


def maintain_generation(
    store: Store,
    name: str,
    signature: str,
    through: int,
    build: Callable[[int], DataFrame],
    extend: Callable[[int, int], DataFrame],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
) -> str:
    """Extend the current generation while its signature holds, else rebuild it.

    ``build(high)`` gives the aggregates of all revisions up to ``high``,
    ``extend(low, high)`` those above ``low``, ``merge`` adds two of them up. The
    covered revision is part of the pointer row, so rows and revision move as one.
    """
    found = store.current(name)
    held, _, covered = (found[1] or "").rpartition("@") if found else ("", "", "")
    stamp = f"{signature}@{through}"
    if not found or held != signature:
        store.publish({name: build(through)}, signature=stamp)
        return "rebuilt"
    done = int(covered)
    if done >= through:
        return "unchanged"
    store.publish({name: merge(store.read(name), extend(done, through))}, signature=stamp)
    return "extended"
