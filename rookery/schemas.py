"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _B, _I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()

ACTIVITY = _struct(
    activity_id=_S, source=_S, actor_login=_S, actor_key=_S, actor_id=_S, type=_S, title=_S,
    link=_S, repo=_S, hidden=_B, published_ms=_L, created_ms=_L,
)
ACTIVITY_BODY = _struct(activity_id=_S, summary=_S, content=_S, version=_S)
ACTIVITY_CHANGE = _struct(seq=_L, source=_S, activity_id=_S, actor_key=_S, actor_id=_S, created_ms=_L)
RETENTION = _struct(
    actor_key=_S, compacted_through_seq=_L, retention_generation=_L, oldest_ms=_L, oldest_id=_S
)
GATE = _struct(data_epoch=_S, proof_epoch=_S, reconciled_ms=_L, cleanup_enabled_ms=_L)
MEMBER = _struct(
    viewer_id=_I, revision=_S, actor_key=_S, login=_S, legacy_keys=T.ArrayType(_S), position=_L
)
RULE = _struct(viewer_id=_I, rule_id=_S, name=_S, rule_text=_S, created_ms=_L, deleted=_B)
MUTATION = _struct(
    entity_id=_L, arrival=_L, mutation_id=_S, attempt_id=_S, base_version=_L, kind=_S, name=_S,
    value=_S,
)
MUTATION_RESULT = _struct(
    entity_id=_L, arrival=_L, mutation_id=_S, attempt_id=_S, outcome=_S, version=_L, deleted=_B
)
OUTCOME = _struct(step=_S, subject=_S, ok=_B, items=_L, message=_S)
