"""User-state mutations as a stateful stream: compare and set per entity.

The state store holds, per entity, its version, its tombstone and its last attempt, and a
receipt for each attempt that took effect. A timer drops receipts after their time; the
last attempt on the entity still answers then. No table is read back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rookery import schemas
from rookery.operators.fold import applies

#: How long receipts stay: thirty days.
RECEIPT_MS = 30 * 24 * 3_600_000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# With timers on processing time Spark would run batches without data for ever; here they
# fire with the next delivery.
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MutationState(StatefulProcessor):
    """Mutations of one entity, in order of arrival within and across deliveries."""

    def __init__(self, receipt_ms: int = RECEIPT_MS) -> None:
        self.receipt_ms = receipt_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entity = handle.getValueState("entity", "version long, deleted boolean, last_attempt_id string")
        self.receipts = handle.getMapState("receipts", "attempt_id string", "applied_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """``rows``: what this delivery has for the entity."""
        version, deleted, last = self.entity.get() if self.entity.exists() else (0, False, None)
        now, moved, out = timerValues.getCurrentProcessingTimeInMs(), False, []
        delivered = pd.concat(list(rows)).sort_values("arrival")
        columns = (delivered[c] for c in ("arrival", "mutation_id", "attempt_id", "base_version", "kind"))
        for arrival, mutation, attempt, base, kind in zip(*columns, strict=True):
            named = attempt is not None
            if named and (attempt == last or self.receipts.containsKey((attempt,))):
                outcome = "already-applied"
            elif applies(version, deleted, base, kind):
                outcome, version, deleted, last, moved = "applied", version + 1, kind == "delete", attempt, True
                if named:
                    self.receipts.updateValue((attempt,), (now,))
            else:
                outcome = "conflict"
            out.append((key[0], arrival, mutation, attempt, outcome, version, deleted))
        if moved:
            self.entity.update((version, deleted, last))
            self.handle.registerTimer(now + self.receipt_ms)
        yield pd.DataFrame(out, columns=schemas.MUTATION_RESULT.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Drop the receipts whose time is over."""
        over = expiredTimerInfo.getExpiryTimeInMs() - self.receipt_ms
        for attempt in [k for k, v in self.receipts.iterator() if v[0] <= over]:
            self.receipts.removeKey(attempt)
        yield pd.DataFrame([], columns=schemas.MUTATION_RESULT.names)

    def close(self) -> None:
        pass


def mutation_outcomes(source: DataFrame, receipt_ms: int = RECEIPT_MS) -> DataFrame:
    """Stream of outcomes of a stream of mutations."""
    source.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    source.sparkSession.conf.set(_EMPTY_BATCHES, "false")
    narrow = source.select("entity_id", "arrival", "mutation_id", "attempt_id", "base_version", "kind")
    return narrow.groupBy("entity_id").transformWithStateInPandas(
        MutationState(receipt_ms), schemas.MUTATION_RESULT, "Append", "ProcessingTime"
    )
