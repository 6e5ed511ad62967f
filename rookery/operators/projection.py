"""Per-viewer projection facts, their aggregates and generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.digest import counted_digest
from rookery.operators import feed
from rookery.operators import rules as R


def facts(
    activity: DataFrame,
    membership: DataFrame,
    viewer: int,
    rule_texts: Sequence[str],
    cleared: Column | None = None,
) -> DataFrame:
    """One row per activity: canonical member and visible 0 / 1 for one viewer."""
    mine = membership.filter(F.col("viewer_id") == viewer).select(
        F.col("key").alias("_key"), F.col("actor_key").alias("member_key")
    )
    hidden = R.hidden_by(rule_texts, R.activity_fields(activity))
    shown = ~hidden & ~F.coalesce(F.col("hidden"), F.lit(False))
    if cleared is not None:
        shown = shown & ~cleared
    # The rules are evaluated inside the scan, before the membership join.
    rated = activity.withColumn("_shown", shown)
    visible = (F.col("member_key").isNotNull() & F.col("_shown")).cast("int")
    keep = [c for c in ("seq", "inserted_revision") if c in activity.columns]
    return rated.join(mine, rated["actor_key"] == mine["_key"], "left").select(
        "activity_id", "actor_key", "member_key", "type", "published_ms", *keep, visible.alias("visible")
    )


def aggregates(fact_rows: DataFrame) -> DataFrame:
    """All three aggregates of the visible facts in one pass, told apart by ``level``.

    ``GROUPING SETS`` reads the facts once: (actor, type), (type) and (member).
    """
    shown = fact_rows.filter(F.col("visible") == 1)
    sets = [
        [F.col("actor_key"), F.col("type")],
        [F.col("type")],
        [F.col("member_key")],
    ]
    level = (
        F.when(F.grouping("member_key") == 0, F.lit("member"))
        .when(F.grouping("actor_key") == 0, F.lit("actor_type"))
        .otherwise(F.lit("type"))
    )
    return (
        shown.groupingSets(sets, F.col("actor_key"), F.col("type"), F.col("member_key"))
        .agg(
            level.alias("level"),
            F.count("*").alias("n"),
            F.max("published_ms").alias("latest_ms"),
        )
        .select("level", "actor_key", "type", "member_key", "n", "latest_ms")
    )


AGGREGATE_KEYS = ("level", "actor_key", "type", "member_key")


def merge_aggregates(old: DataFrame, delta: DataFrame) -> DataFrame:
    return feed.merge_stats(old, delta, *AGGREGATE_KEYS)


def statistics(actor_type: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Count per type over the (actor, type) aggregate, for all or chosen actors."""
    chosen = actor_type
    if keys is not None:
        chosen = actor_type.join(
            keys.select(F.col("key").alias("actor_key")).distinct(), "actor_key", "left_semi"
        )
    return chosen.groupBy("type").agg(F.sum("n").alias("n"))


def refresh_summary(members: DataFrame, summary: DataFrame) -> DataFrame:
    """New display names on unchanged counts; members without activity get 0."""
    stats = summary.select(F.col("member_key").alias("actor_key"), "n", "latest_ms")
    return members.select("actor_key", "login").join(stats, "actor_key", "left").select(
        "actor_key",
        F.lower("login").alias("login"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("latest_ms", F.lit(0)).alias("latest_ms"),
    )


def signatures(
    rules: DataFrame, membership_signatures: DataFrame, cleaner_version: str
) -> DataFrame:
    """(viewer_id, signature): what the projection of each viewer depends on.

    Valid live rules by id and canonical text, the member set and the cleaner
    version. Rule names and rule order do not count. ``membership_signatures``:
    (viewer_id, signature).
    """
    live = R.with_canonical_text(R.live(rules)).filter(F.col("canonical").isNotNull())
    line = F.concat_ws(":", "rule_id", "canonical")
    held = live.groupBy("viewer_id").agg(counted_digest(line).alias("_rules"))
    return membership_signatures.join(held, "viewer_id", "full").select(
        "viewer_id",
        F.sha2(
            F.concat_ws(
                "|",
                F.coalesce("_rules", F.lit("none")),
                F.coalesce("signature", F.lit("none")),
                F.lit(cleaner_version),
            ),
            256,
        ).alias("signature"),
    )
