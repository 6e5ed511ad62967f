"""Versioned user state: watermarks, pulls, overlay, merge, change capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.values import clamp
from rookery.operators.joins import split_join
from rookery.operators.rules import with_canonical_text

def entity_state(results: DataFrame, log: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Current (entity_id, version, deleted, name, value) after the fold.

    The value is that of the last applied put; a tombstone keeps it.
    """
    applied = results.filter(F.col("outcome") == "applied").select(
        "entity_id", "arrival", "version", "deleted"
    )
    rows = applied.join(log.select("entity_id", "arrival", "kind", "name", "value"), ["entity_id", "arrival"])
    put = F.when(F.col("kind") == "put", F.struct("name", "value"))
    new = rows.groupBy("entity_id").agg(
        F.max("version").alias("version"),
        F.max_by("deleted", "version").alias("deleted"),
        F.max_by(put, F.when(put.isNotNull(), F.col("version"))).alias("_v"),
    ).select("entity_id", "version", "deleted", "_v.name", "_v.value")
    if old is None:
        return new
    both = old.alias("o").join(new.alias("n"), "entity_id", "full")
    newer = F.col("n.version").isNotNull()

    def pick(c: str, keep: bool = False) -> Column:
        chosen = F.coalesce(f"n.{c}", f"o.{c}") if keep else F.col(f"n.{c}")
        return F.when(newer, chosen).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(
        "entity_id", pick("version"), pick("deleted"), pick("name", True), pick("value", True)
    )


def entity_rows(results: DataFrame) -> DataFrame:
    """(entity_id, version, deleted, last_attempt_id) after the applied mutations: what an
    entity's row still knows when its receipts are gone."""
    newest = F.max_by(F.struct("deleted", "attempt_id"), "version").alias("_row")
    rows = results.filter("outcome = 'applied'").groupBy("entity_id").agg(F.max("version").alias("version"), newest)
    return rows.select("entity_id", "version", "_row.deleted", F.col("_row.attempt_id").alias("last_attempt_id"))


def advance_watermark(
    state: DataFrame, candidates: DataFrame, now_ms: int
) -> DataFrame:
    """Monotone clear watermark: (user_id, cleared_ms, version).

    ``state``: (user_id, cleared_ms, version); ``candidates``: (user_id, anchor_ms,
    candidate_ms). A candidate without an anchor means "now".
    """
    now = F.lit(now_ms).cast("long")
    wanted = F.when(
        F.col("anchor_ms").isNotNull(), clamp(F.col("candidate_ms"), F.col("anchor_ms"), now)
    ).otherwise(now)
    best = candidates.groupBy("user_id").agg(F.max(wanted).alias("_best"))
    old, new = F.col("cleared_ms"), F.col("_best")
    grew = F.coalesce(new > F.coalesce(old, F.lit(-1).cast("long")), F.lit(False))
    return state.join(best, "user_id", "full").select(
        "user_id",
        F.greatest("cleared_ms", "_best").alias("cleared_ms"),
        (F.coalesce("version", F.lit(0)) + grew.cast("long")).alias("version"),
    )


def log_heads(log: DataFrame) -> DataFrame:
    """Head sequence and number of changes per user."""
    return log.groupBy("user_id").agg(F.max("seq").alias("head_seq"), F.count("*").alias("n"))


def changed_revisions(log: DataFrame) -> DataFrame:
    """Sequence of the last change of each entity."""
    return log.groupBy("user_id", "entity_id").agg(F.max("seq").alias("changed_revision"))


def pull_state(requests: DataFrame, log: DataFrame, states: DataFrame, entities: DataFrame) -> DataFrame:
    """Answer many pull requests: (user_id, mode, entity_id, version).

    ``requests``: (user_id, after_seq, epoch); ``states``: (user_id, floor_seq,
    head_seq, epoch). Another epoch or a position below the floor means a full
    snapshot with tombstones; else each entity changed in (after, head] once.
    """
    snapshot = ~F.col("q.epoch").eqNullSafe(F.col("s.epoch")) | (
        F.col("after_seq") < F.col("floor_seq")
    )
    modes = (
        requests.alias("q")
        .join(states.alias("s"), "user_id")
        .select(
            "user_id",
            F.when(snapshot, F.lit("snapshot")).otherwise(F.lit("delta")).alias("mode"),
            "after_seq",
            "head_seq",
        )
    )
    changed = (
        split_join(log, modes.filter(F.col("mode") == "delta"), ["user_id"])
        .filter((F.col("seq") > F.col("after_seq")) & (F.col("seq") <= F.col("head_seq")))
        .select("user_id", "mode", "entity_id")
        .distinct()
    )
    delta = changed.join(entities, ["user_id", "entity_id"])
    full = split_join(
        entities, modes.filter(F.col("mode") == "snapshot").select("user_id", "mode"), ["user_id"]
    )
    return full.select("user_id", "mode", "entity_id", "version").unionByName(
        delta.select("user_id", "mode", "entity_id", "version")
    )


def overlay(replicas: DataFrame, pending: DataFrame) -> DataFrame:
    """Replica rows overlaid by the last pending operation of each key.

    ``replicas``: (id, value, deleted); ``pending``: (id, kind, value,
    local_sequence, conflict_copy).
    """
    last = pending.groupBy("id").agg(
        F.max_by(F.struct("kind", "value", "conflict_copy"), "local_sequence").alias("_p")
    )
    both = replicas.filter(~F.col("deleted")).alias("r").join(last.alias("l"), "id", "full")
    op = F.col("_p.kind")
    sync = (
        F.when(op.isNull(), F.lit("synced"))
        .when(F.col("_p.conflict_copy"), F.lit("conflict-copy"))
        .otherwise(F.lit("pending"))
    )
    return both.filter(F.coalesce(op, F.lit("put")) == "put").select(
        "id",
        F.when(op.isNull(), F.col("r.value")).otherwise(F.col("_p.value")).alias("value"),
        sync.alias("sync"),
    )


def overlay_clear(server: DataFrame, pending: DataFrame) -> DataFrame:
    """Optimistic clear watermark and the local sequence it covers, per user."""
    clears = pending.groupBy("user_id").agg(
        F.max("candidate_ms").alias("_best"), F.max("local_sequence").alias("_last")
    )
    return server.join(clears, "user_id", "full").select(
        "user_id",
        F.greatest("cleared_ms", "_best").alias("cleared_ms"),
        (F.col("_last") - 1).alias("provisional_through"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def three_way_merge(
    base: DataFrame, local: DataFrame, remote: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Merge three versions of a keyed table: (key, status, fields).

    An unchanged side yields to the other; equal sides agree; else each field is
    merged on its own and any field changed on both sides is a conflict. A row
    missing on a side can only agree with a side that misses it too.
    """
    sides = {"b": base, "l": local, "r": remote}
    tagged = [
        df.select(key, F.struct(*fields).alias(name)) for name, df in sides.items()
    ]
    joined = tagged[0].join(tagged[1], key, "full").join(tagged[2], key, "full")
    b, l, r = F.col("b"), F.col("l"), F.col("r")
    take_remote = _same(l, b)
    take_local = _same(r, b) | _same(l, r)
    present = b.isNotNull() & l.isNotNull() & r.isNotNull()

    def field_ok(f: str) -> Column:
        bf, lf, rf = b[f], l[f], r[f]
        return _same(lf, bf) | _same(rf, bf) | _same(lf, rf)

    def field_value(f: str) -> Column:
        return F.when(_same(l[f], b[f]), r[f]).otherwise(l[f])

    all_ok = present
    for f in fields:
        all_ok = all_ok & field_ok(f)
    status = F.when(take_remote, F.when(r.isNull(), "deleted").otherwise("merged")).when(
        take_local, F.when(l.isNull(), "deleted").otherwise("merged")
    ).when(all_ok, "merged").otherwise("conflict")
    values = [
        F.when(take_remote, r[f])
        .when(take_local, l[f])
        .when(all_ok, field_value(f))
        .alias(f)
        for f in fields
    ]
    return joined.select(key, status.alias("status"), *values)


def merge_lists(merged: DataFrame, parent: Column) -> DataFrame:
    """Verdict of lists merged by item id: one conflicting item spoils its list."""
    return merged.groupBy(parent.alias("parent")).agg(
        F.when(F.bool_or(F.col("status") == "conflict"), F.lit("conflict"))
        .otherwise(F.lit("merged"))
        .alias("status"),
        F.count_if(F.col("status") == "merged").alias("n_items"),
    )


def rule_conditions(rules: DataFrame) -> DataFrame:
    """(rule_id, item, condition): the top-level conditions of rule texts by condition id."""
    parts = F.from_json(F.get_json_object("rule_text", "$.conditions"), "array<string>")
    return rules.select("rule_id", F.explode(parts).alias("condition")).select(
        "rule_id",
        F.to_json(F.struct("rule_id", F.get_json_object("condition", "$.id").alias("id"))).alias("item"),
        "condition",
    )


def merge_conditions(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Verdict per rule when its conditions are merged by id: (parent, status, n_items)."""
    sides = [rule_conditions(df).select("item", "condition") for df in (base, local, remote)]
    merged = three_way_merge(*sides, "item", ["condition"])
    return merge_lists(merged, F.get_json_object("item", "$.rule_id"))


def split_conflicts(outbox: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Move a conflicting operation and all later ones of its chain to a new id.

    ``outbox``: (entity_id, local_sequence, attempt_id, base_version); ``conflicts``:
    (entity_id, at_sequence). New ids are hashes, so a re-run gives the same ones.
    """
    moved = F.col("at_sequence").isNotNull() & (F.col("local_sequence") >= F.col("at_sequence"))
    hit = F.coalesce(moved, F.lit(False))
    here = F.col("local_sequence") == F.col("at_sequence")
    fresh = F.sha2(F.concat_ws(":", F.lit("copy"), "entity_id", "at_sequence"), 256)
    attempt = F.sha2(F.concat_ws(":", F.lit("attempt"), "attempt_id", "local_sequence"), 256)
    return split_join(outbox, conflicts, ["entity_id"], "left").select(
        F.when(hit, fresh).otherwise(F.col("entity_id").cast("string")).alias("entity_id"),
        "local_sequence",
        F.when(hit, attempt).otherwise(F.col("attempt_id")).alias("attempt_id"),
        F.when(hit & here, F.lit(0).cast("long")).otherwise(F.col("base_version")).alias("base_version"),
        hit.alias("conflict_copy"),
    )


def mark_blocked(outbox: DataFrame) -> DataFrame:
    """Puts whose merged rule is not valid are blocked and become conflict copies.

    ``outbox``: (.., kind, rule_text, conflict_copy).
    """
    blocked = (F.col("kind") == "put") & F.col("canonical").isNull()
    return (
        with_canonical_text(outbox)
        .withColumn("status", F.when(blocked, F.lit("blocked")).otherwise(F.lit("pending")))
        .withColumn("conflict_copy", F.col("conflict_copy") | blocked)
        .drop("canonical")
    )


def derive_changes(
    before: DataFrame, after: DataFrame, key: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Log rows for plain inserts, updates and deletes between two snapshots.

    Both hold ``version``. Update and delete move it by one; a delete leaves a
    tombstone; an unchanged row gives nothing.
    """
    old = before.select(*key, F.struct(*fields).alias("_old"), F.col("version").alias("_v"))
    new = after.select(*key, F.struct(*fields).alias("_new"))
    both = old.join(new, list(key), "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    change = (
        F.when(F.col("_old").isNull(), F.lit("insert"))
        .when(F.col("_new").isNull(), F.lit("delete"))
        .otherwise(F.lit("update"))
    )
    return both.select(
        *key,
        change.alias("change"),
        (F.coalesce("_v", F.lit(0).cast("long")) + 1).alias("version"),
        F.col("_new").isNull().alias("deleted"),
    )


def acknowledge(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Operations still pending: answered ones go, conflicts stay under a new attempt."""
    verdict = results.select("mutation_id", "outcome")
    retry = F.sha2(F.concat_ws(":", F.lit("retry"), "mutation_id", "attempt_id"), 256)
    return (
        pending.join(verdict, "mutation_id", "left")
        .filter(F.col("outcome").isNull() | (F.col("outcome") == "conflict"))
        .withColumn(
            "attempt_id",
            F.when(F.col("outcome") == "conflict", retry).otherwise(F.col("attempt_id")),
        )
        .drop("outcome")
    )
