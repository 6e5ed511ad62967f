"""Feed, following and statistics queries for one viewer or for all at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators import rules as R
from rookery.operators.joins import split_join
from rookery.operators.ranking import numbered, numbered_within, top_n

PAGE_SIZE = 20
# Types shown first in the type list.
PINNED_TYPES = ("star", "pr_merged")


def newest_first() -> list[Column]:
    """Feed order: publication time, then id, both descending."""
    return [F.desc("published_ms"), F.desc("activity_id")]


def base(activity: DataFrame, cleared_ms: int | None = None) -> DataFrame:
    """Not hidden, and published after the clear watermark when there is one."""
    out = activity.filter(~F.col("hidden"))
    return out if cleared_ms is None else out.filter(F.col("published_ms") > cleared_ms)


def restrict(
    df: DataFrame, users: Sequence[str] = (), types: Sequence[str] = ()
) -> DataFrame:
    """In-list limits; an empty list does not restrict."""
    if users:
        df = df.filter(F.col("actor_login").isin(list(users)))
    return df.filter(F.col("type").isin(list(types))) if types else df


def is_cleared(fence_ms: Column, fence_revision: Column) -> Column:
    """Cleared by publication time or by inserted revision, bounds included."""
    return F.coalesce(F.col("published_ms") <= fence_ms, F.lit(False)) | F.coalesce(
        F.col("inserted_revision") <= fence_revision, F.lit(False)
    )


def followed(activity: DataFrame, users: DataFrame, subscriptions: DataFrame, viewer: int) -> DataFrame:
    """Activity of known accounts that ``viewer`` follows, matched by login."""
    mine = subscriptions.filter(F.col("viewer_id") == viewer).select("login")
    known = users.select("login").join(mine, "login", "left_semi")
    return split_join(activity, known.withColumnRenamed("login", "actor_login"), ["actor_login"], "left_semi")


def visible_feed(
    activity: DataFrame,
    users: DataFrame,
    subscriptions: DataFrame,
    viewer: int,
    rule_texts: Sequence[str],
    cleared_ms: int | None = None,
) -> DataFrame:
    """Everything one viewer may see."""
    # Rules run below the join: they drop rows before anything is exchanged.
    kept = R.visible(base(activity, cleared_ms), rule_texts)
    return followed(kept, users, subscriptions, viewer)


def page_desc(df: DataFrame, n: int, after: tuple[int, str] | None = None) -> DataFrame:
    """Next ``n`` rows newest first, plus one probe row that tells "has more".

    The page starts strictly below the key ``after`` = (published_ms, id). The
    plain time bound is redundant; it lets the scan skip row groups.
    """
    if after is not None:
        at, key = after
        df = df.filter(F.col("published_ms") <= at).filter(
            (F.col("published_ms") < at) | (F.col("activity_id") < key)
        )
    return df.orderBy(*newest_first()).limit(n + 1)


def page_state(rows: Sequence, n: int) -> tuple[Sequence, bool, tuple[int, str] | None]:
    """(rows of the page, has_more, next key) of a collected page of n + 1 rows."""
    kept, has_more = rows[:n], len(rows) > n
    key = (kept[-1]["published_ms"], kept[-1]["activity_id"]) if has_more else None
    return kept, has_more, key


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"))


def pin_ranked(counts: DataFrame) -> DataFrame:
    """Add ``pin_rank``: the place of a pinned type, one common value for the rest."""
    pins = [F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(PINNED_TYPES)]
    return counts.withColumn("pin_rank", F.coalesce(*pins, F.lit(len(PINNED_TYPES))))


def type_order(counts: DataFrame) -> DataFrame:
    """Pinned types first, then by count; ties by name."""
    return numbered(pin_ranked(counts), [F.col("pin_rank"), F.desc("n"), F.col("type")], "place")


def stats_by(df: DataFrame, *keys: str) -> DataFrame:
    """Row count and latest publication by ``keys``."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("published_ms").alias("latest_ms")
    )


def following_list(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Followed accounts of every viewer with their account facts."""
    return split_join(subscriptions, users, ["login"])


def with_stats(following: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left merge of per-account stats: 0 and NULL where there is no activity."""
    return split_join(following, stats, [key], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def following_stats_all(
    activity: DataFrame, users: DataFrame, subscriptions: DataFrame
) -> DataFrame:
    """Follow list of all viewers with counts, without rules.

    Counts are per account, so they are aggregated before the fan-out to viewers.
    """
    stats = stats_by(base(activity), "actor_login").withColumnRenamed("actor_login", "login")
    return with_stats(following_list(users, subscriptions), stats, "login")


def _classes(
    activity: DataFrame, membership: DataFrame, rules: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Activity with rule hits, and follow edges.

    A rule is tried on the activity of an account once, however many of the account's
    followers hold it.
    """
    followed = membership.select("viewer_id", F.col("key").alias("actor_key"))
    return R.with_hits(base(activity), followed, R.held_rules(rules)), followed


def rule_counts(activity: DataFrame, membership: DataFrame, rules: DataFrame) -> DataFrame:
    """``viewer_id, rule_text, n_rows``: rows of followed accounts on which a viewer's rule is
    TRUE, for rules with such rows. Rows are counted by (account, rule) before the follow
    lists meet them.
    """
    followed = membership.select("viewer_id", F.col("key").alias("actor_key")).distinct()
    held = R.held_rules(rules)
    rows = R.with_hits(base(activity), followed, held)
    counts = (
        rows.select("actor_key", F.explode("hits").alias("rule_id"))
        .groupBy("actor_key", "rule_id")
        .agg(F.count("*").alias("n_rows"))
    )
    mine = counts.join(followed, "actor_key").groupBy("viewer_id", "rule_id").agg(F.sum("n_rows").alias("n_rows"))
    return held.join(mine, ["viewer_id", "rule_id"]).drop("rule_id")


def _unhidden(classes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Classes with every follower none of whose rules hit them. Hits meet the followers one
    by one: no list of a viewer's rules travels."""
    held = R.held_rules(rules).select("viewer_id", "rule_id")
    hit = classes.select("actor_key", "hits").filter(F.size("hits") > 0).distinct()
    hidden = (
        hit.withColumn("rule_id", F.explode("hits"))
        .join(edges.distinct(), "actor_key")
        .join(held, ["viewer_id", "rule_id"], "left_semi")
        .select("viewer_id", "actor_key", "hits")
        .distinct()
    )
    return classes.join(edges, "actor_key").join(hidden, ["viewer_id", "actor_key", "hits"], "left_anti")


def visible_counts_all(activity: DataFrame, membership: DataFrame, rules: DataFrame) -> DataFrame:
    """Visible rows and latest time per viewer and type, in one pass for all viewers.

    Rows are first reduced to (actor, type, set of rules hit); only these
    classes meet the follow lists, so the fan-out carries no single activities.
    """
    rows, edges = _classes(activity, membership, rules)
    classes = stats_by(rows, "actor_key", "type", "hits")
    return (
        _unhidden(classes, edges, rules)
        .groupBy("viewer_id", "type")
        .agg(F.sum("n").alias("n"), F.max("latest_ms").alias("latest_ms"))
    )


def visible_newest_all(
    activity: DataFrame, membership: DataFrame, rules: DataFrame, n: int
) -> DataFrame:
    """Newest ``n`` visible rows of every viewer.

    Any viewer sees all or none of a class (actor, set of rules hit), so only the
    newest ``n`` of each class can reach a page; the rest stays out of the join.
    """
    rows, edges = _classes(activity, membership, rules)
    narrow = rows.select("activity_id", "actor_key", "type", "published_ms", "hits")
    candidates = top_n(narrow, ["actor_key", "hits"], newest_first(), n)
    return top_n(_unhidden(candidates, edges, rules), ["viewer_id"], newest_first(), n, "position")


def paginate_all(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Page number of every row of every group, newest first."""
    ranked = numbered_within(df, group, newest_first(), "_rank")
    return ranked.withColumn("page", F.floor(F.col("_rank") / n)).drop("_rank")


def merge_newest(lanes: Sequence[DataFrame], n: int) -> DataFrame:
    """Newest ``n`` over several lanes; a row in two lanes counts once.

    Each lane is cut to its own newest ``n`` first.
    """
    merged = None
    for lane in lanes:
        cut = lane.orderBy(*newest_first()).limit(n)
        merged = cut if merged is None else merged.unionByName(cut)
    return merged.dropDuplicates(["activity_id"]).orderBy(*newest_first()).limit(n)


def materialise_rows(keys: DataFrame, activity: DataFrame, bodies: DataFrame) -> DataFrame:
    """Fetch wide rows for few chosen ids: ``keys`` prunes both joins."""
    return keys.select("activity_id").join(activity, "activity_id").join(bodies, "activity_id", "left")


def following_sorted(summary: DataFrame, mode: str) -> DataFrame:
    """``place`` of each row: latest first with no-activity members last, or by name."""
    order = [F.col("login"), F.col("actor_key")]
    return numbered(summary, order if mode == "name" else [F.desc_nulls_last("latest_ms"), *order], "place")


def summary_by_member(
    stats: DataFrame, membership: DataFrame, keep_strangers: bool = False
) -> DataFrame:
    """Fold per-key stats into canonical members.

    Rows of non-members are dropped, or kept under their own key. ``stats``:
    (actor_key, n, latest_ms); ``membership``: (viewer_id, key, actor_key).
    """
    alias = membership.select(
        "viewer_id", F.col("key").alias("actor_key"), F.col("actor_key").alias("_to")
    )
    # The edges may be hot: a popular account has very many followers.
    joined = split_join(stats, alias, ["actor_key"], "left" if keep_strangers else "inner")
    return (
        joined.groupBy("viewer_id", F.coalesce("_to", "actor_key").alias("member_key"))
        .agg(F.sum("n").alias("n"), F.max("latest_ms").alias("latest_ms"))
    )


def merge_stats(old: DataFrame, delta: DataFrame, *keys: str) -> DataFrame:
    """Add counts and take the later time of two partial aggregates."""
    return (
        old.unionByName(delta)
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.max("latest_ms").alias("latest_ms"))
    )


def authorise(activity: DataFrame, membership: DataFrame, viewer: int) -> DataFrame:
    """Found / not-authorised per activity, by key or any alias of a member."""
    mine = membership.filter(F.col("viewer_id") == viewer).select(
        F.col("key").alias("actor_key"), F.lit(True).alias("_member")
    )
    verdict = F.when(F.col("_member"), F.lit("found")).otherwise(F.lit("not-authorised"))
    return (
        activity.filter(~F.col("hidden"))
        .join(mine, "actor_key", "left")
        .select("activity_id", verdict.alias("result"))
    )


# Refresh queue -----------------------------------------------------------------

COOLDOWN_MS, CLAIM_TIMEOUT_MS, QUEUE_LIMIT = 5 * 60_000, 10 * 60_000, 50


def is_due(now_ms: int) -> Column:
    """Not refreshed within the cool-down and not claimed within the time-out."""
    recent = F.col("last_refreshed_ms") >= now_ms - COOLDOWN_MS
    claimed = F.col("refresh_claimed_ms") >= now_ms - CLAIM_TIMEOUT_MS
    return ~F.coalesce(recent, F.lit(False)) & ~F.coalesce(claimed, F.lit(False))


def active_targets(users: DataFrame, subscriptions: DataFrame, viewers: DataFrame) -> DataFrame:
    """Accounts followed by at least one registered viewer."""
    live = subscriptions.join(viewers.select("viewer_id"), "viewer_id", "left_semi")
    return users.join(live.select("login").distinct(), "login", "left_semi")


def refresh_queue(targets: DataFrame, now_ms: int, limit: int = QUEUE_LIMIT) -> DataFrame:
    """Least recently refreshed first, never refreshed before all; then the due test."""
    chosen = targets.orderBy(F.asc_nulls_first("last_refreshed_ms"), "login").limit(limit)
    return chosen.withColumn("due", is_due(now_ms))


def first_refresh_queue(targets: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """Never refreshed accounts by age of the account row."""
    never = targets.filter(F.col("last_refreshed_ms").isNull())
    return never.orderBy("created_ms", "login").limit(limit)
