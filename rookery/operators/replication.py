"""History and delta reads of the change log, gaps, coverage and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.operators.feed import newest_first
from rookery.operators.joins import split_join
from rookery.operators.ranking import top_n

_KEY = ["source", "activity_id"]


def changes_with_rows(changes: DataFrame, activity: DataFrame) -> DataFrame:
    """Log rows with their activity; ``change_key`` is the actor key the log holds."""
    rows = activity.drop("seq") if "seq" in activity.columns else activity
    log = changes.select("seq", *_KEY, F.col("actor_key").alias("change_key"))
    return log.join(rows, _KEY)


def in_scope(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is one of the scope keys."""
    return df.join(keys.select(F.col("key").alias(column)), column, "left_semi")


def history_page(
    changes: DataFrame,
    activity: DataFrame,
    keys: DataFrame,
    through: int,
    n: int,
    after: tuple[int, str] | None = None,
) -> DataFrame:
    """Publication-ordered page of the scope, bounded by ``seq <= through``.

    Holds n + 1 rows; fewer than that means the end is reached.
    """
    rows = in_scope(activity.filter(~F.col("hidden")), keys, "actor_key")
    if after is not None:
        at, key = after
        rows = rows.filter(F.col("published_ms") <= at).filter(
            (F.col("published_ms") < at) | (F.col("activity_id") < key)
        )
    log = changes.filter(F.col("seq") <= through)
    return changes_with_rows(log, rows).orderBy(*newest_first()).limit(n + 1)


def delta_page(
    changes: DataFrame,
    activity: DataFrame,
    keys: DataFrame,
    from_seq: int,
    through: int,
    n: int,
    after: tuple[int, str] | None = None,
) -> DataFrame:
    """Log-ordered page of the scope: ``from_seq < seq <= through``, n + 1 rows.

    Reads by sequence, never by publication time, so a late publication arrives.
    """
    log = changes.filter(F.col("seq").between(from_seq + 1, through))
    if after is not None:
        seq, key = after
        log = log.filter(F.col("seq") >= seq).filter(
            (F.col("seq") > seq) | (F.col("activity_id") > key)
        )
    log = in_scope(log, keys, "actor_key")
    rows = changes_with_rows(log, activity.filter(~F.col("hidden")))
    return rows.orderBy("seq", "activity_id").limit(n + 1)


def scoped_changes(changes: DataFrame, activity: DataFrame, bounds: DataFrame) -> DataFrame:
    """Delta or history of many scopes in one join.

    ``bounds``: (viewer_id, key, from_seq); a history read starts at 0. The log
    meets the activity once, before the fan-out to viewers.
    """
    visible = activity.filter(~F.col("hidden")).select(*_KEY, "published_ms")
    log = changes.select("seq", *_KEY, F.col("actor_key").alias("key"))
    return log.join(visible, _KEY).join(bounds, "key").filter(F.col("seq") > F.col("from_seq"))


def plan_reads(gaps: DataFrame) -> DataFrame:
    """Per request: delta from its position, or history replay from 0 after a gap.

    ``gaps``: (viewer_id, from_seq, gap_through_seq).
    """
    gap = F.col("gap_through_seq").isNotNull()
    return gaps.select(
        "viewer_id",
        F.when(gap, F.lit("history")).otherwise(F.lit("delta")).alias("action"),
        F.when(gap, F.lit(0).cast("long")).otherwise(F.col("from_seq")).alias("from_seq"),
    )


def recover_gap(
    changes: DataFrame, activity: DataFrame, scope: DataFrame, gaps: DataFrame, through: int
) -> DataFrame:
    """Rows each viewer receives, and the checkpoint it holds afterwards."""
    plan = plan_reads(gaps)
    bounds = plan.join(scope, "viewer_id").select("viewer_id", "key", "from_seq")
    read = (
        scoped_changes(changes.filter(F.col("seq") <= through), activity, bounds)
        .groupBy("viewer_id")
        .agg(F.count("*").alias("n_rows"))
    )
    return plan.join(read, "viewer_id", "left").select(
        "viewer_id",
        "action",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.lit(through).cast("long").alias("checkpoint_seq"),
    )


def transition_bounds(
    old_keys: DataFrame, new_keys: DataFrame, positions: DataFrame
) -> DataFrame:
    """Where to read each key of the new scope from.

    Keys the old scope held continue at the old position; added keys start at 0.
    Keys of a viewer are disjoint, so no activity arrives twice.
    """
    held = old_keys.select("viewer_id", "key", F.lit(True).alias("_held"))
    return (
        new_keys.select("viewer_id", "key")
        .join(held, ["viewer_id", "key"], "left")
        .join(positions, "viewer_id")
        .select(
            "viewer_id",
            "key",
            F.when(F.col("_held"), F.col("from_seq")).otherwise(F.lit(0)).alias("from_seq"),
            F.coalesce("_held", F.lit(False)).alias("held"),
        )
    )


def scope_transition(
    changes: DataFrame,
    activity: DataFrame,
    old_keys: DataFrame,
    new_keys: DataFrame,
    positions: DataFrame,
    through: int,
) -> DataFrame:
    """(viewer_id, activity_id, seq, held): what the move to the new scope delivers."""
    bounds = transition_bounds(old_keys, new_keys, positions)
    log = changes.filter(F.col("seq") <= through)
    return scoped_changes(log, activity, bounds).select("viewer_id", "activity_id", "seq", "held")


def coverage(events: DataFrame) -> DataFrame:
    """Last coverage facts by scope from a log of page outcomes.

    ``events``: (scope, at, kind, is_end) with kind history / delta / gap. A gap
    holds until a later history read reaches its end.
    """
    at, kind, end = F.col("at"), F.col("kind"), F.col("is_end")
    history, gap = kind == "history", kind == "gap"
    facts = events.groupBy("scope").agg(
        F.max(F.when(history | gap, at)).alias("_window_at"),
        F.max(F.when(history & end, at)).alias("_end_at"),
        F.max(F.when(gap, at)).alias("_gap_at"),
    )
    exhausted = F.coalesce(F.col("_end_at") == F.col("_window_at"), F.lit(False))
    gapped = F.col("_gap_at") > F.coalesce("_end_at", F.lit(-1).cast("long"))
    return facts.select(
        "scope",
        F.when(F.col("_window_at").isNull(), F.lit("unchecked"))
        .when(exhausted, F.lit("exhausted"))
        .otherwise(F.lit("may-have-more"))
        .alias("remote_window"),
        F.when(F.coalesce(gapped, F.lit(False)), F.lit("gap-detected"))
        .otherwise(F.lit("continuous"))
        .alias("integrity"),
    )


def snapshot_members(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Members of every snapshot; an empty snapshot is one row with NULL member.

    A snapshot that does not exist has no row, so empty and missing differ.
    """
    key = ["viewer_id", "revision"]
    # Not a left join from the snapshots: one huge snapshot could not be split then.
    filled = split_join(members, snapshots, key)
    empty = snapshots.join(members.select(*key).distinct(), key, "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def snapshot_page(members: DataFrame, after_position: int, n: int) -> DataFrame:
    """Next members by position, with one probe row."""
    return members.filter(F.col("position") > after_position).orderBy("position").limit(n + 1)


def prune_revisions(snapshots: DataFrame, members: DataFrame, keep: int = 2) -> DataFrame:
    """Members of the newest ``keep`` snapshots of each viewer."""
    kept = top_n(snapshots, ["viewer_id"], [F.desc("completed_ms"), F.desc("revision")], keep)
    return members.join(kept.select("viewer_id", "revision"), ["viewer_id", "revision"], "left_semi")


def replace_snapshot(current: DataFrame, remote: DataFrame, now_ms: int) -> DataFrame:
    """Authoritative follow list: kept rows keep their time, new rows get ``now_ms``.

    Both sides hold one row per (viewer_id, login). Rows not in ``remote`` go.
    """
    known = current.select("viewer_id", "login", F.col("created_ms").alias("_at"))
    return (
        remote.join(known, ["viewer_id", "login"], "left")
        .withColumn("created_ms", F.coalesce("_at", F.lit(now_ms).cast("long")))
        .drop("_at")
    )


def upsert_users(users: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """Followed accounts enter the account table; a known login only takes the new id."""
    new = members.groupBy("login").agg(F.max("id").alias("_id")).withColumn("_in", F.lit(True))
    both = users.alias("u").join(new.alias("n"), "login", "full")
    return both.select(
        "login",
        F.when(F.col("_in"), F.col("_id")).otherwise(F.col("u.id")).alias("id"),
        "u.last_refreshed_ms",
        "u.refresh_claimed_ms",
        F.coalesce("u.created_ms", F.lit(now_ms).cast("long")).alias("created_ms"),
    )
