"""Append-only ingestion, the change sequence and dimension upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.operators.identity import member_keys
from rookery.operators.joins import split_join
from rookery.operators.ranking import first_by, last_by, numbered

# Account names and the largest exact integer of the wire format.
LOGIN_PATTERN = "(?i)^[a-z0-9-]{1,40}$"
MAX_EXACT_INTEGER = 2**53 - 1


class RejectedLoad(ValueError):
    pass


def unseen(
    batch: DataFrame, store: DataFrame, key: list[str], keys: DataFrame | None = None
) -> DataFrame:
    """Rows of a delivery whose key is not stored.

    The store is first narrowed to the keys of the delivery. Its side of that
    join only streams when the delivery is small, so the whole store is not
    exchanged for every small delivery. ``keys`` holds the keys where they cost less
    than another run of ``batch``.
    """
    delivered = (batch if keys is None else keys).select(*key).distinct()
    held = store.select(*key).join(delivered, key, "left_semi")
    return batch.join(held, key, "left_anti")


def ingest_activity(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose id is not stored yet, one per id.

    Stored rows are never replaced, and ids absent from a batch are not deleted.
    Inside a batch the earliest created row of an id wins.
    """
    # Copies go first: the map side keeps one row per id, so no id is hot below.
    # All columns decide ties, so that a task run again keeps the same copy.
    rest = [c for c in batch.columns if c not in ("activity_id", "created_ms", "published_ms")]
    order = [F.asc(c) for c in ("created_ms", "published_ms", *sorted(rest))]
    single = first_by(batch, ["activity_id"], order)
    # The keys come from the delivery itself, so whole rows are exchanged once.
    return unseen(single, store, ["activity_id"], batch)


def head_seq(changes: DataFrame, stored_head: int = 0) -> int:
    """Highest sequence ever used; never moves back, even after compaction."""
    found = changes.agg(F.max("seq").alias("head")).first()["head"]
    return max(stored_head, found or 0)


def append_changes(changes: DataFrame, rows: DataFrame, stored_head: int = 0) -> DataFrame:
    """New log rows for activities the log does not hold, sequenced after the head.

    One log row per (source, activity_id); a repeat consumes no sequence.
    """
    key = ["source", "activity_id"]
    columns = [*key, "actor_key", "actor_id", "created_ms"]
    order = [F.asc("created_ms"), F.asc("actor_key"), F.asc("actor_id")]
    single = first_by(rows.select(*columns), key, order)
    fresh = unseen(single, changes, key, rows)
    ranked = numbered(fresh, [F.col("created_ms"), F.col("activity_id"), F.col("source")])
    start = head_seq(changes, stored_head) + 1
    return ranked.select((F.lit(start) + F.col("rank")).alias("seq"), *columns)


def check_following(raw: DataFrame) -> DataFrame:
    """Add ``bad`` to loaded follow rows (viewer_id, load_order, id, login)."""
    number = F.col("id").try_cast("long")
    good = (
        F.col("id").rlike(r"^-?\d{1,16}$")
        & F.abs(number).between(0, MAX_EXACT_INTEGER)
        & F.col("login").rlike(LOGIN_PATTERN)
    )
    return raw.withColumn("bad", ~F.coalesce(good, F.lit(False)))


def accepted_following(raw: DataFrame) -> DataFrame:
    """Members of every load without a bad row; the last row of a login wins.

    A load with one bad row is rejected whole, so its old snapshot stays.
    """
    checked = check_following(raw)
    refused = checked.filter("bad").select("viewer_id").distinct()
    rows = split_join(checked, refused, ["viewer_id"], "left_anti")
    rows = rows.withColumn("login", F.lower("login"))
    kept = last_by(rows.drop("bad"), ["viewer_id", "login"], ["load_order"])
    return kept.select("viewer_id", "id", "login")


def load_summary(raw: DataFrame) -> DataFrame:
    """Rows, bad rows and acceptance by viewer."""
    return (
        check_following(raw)
        .groupBy("viewer_id")
        .agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("n_bad"))
        .withColumn("accepted", F.col("n_bad") == 0)
    )


def check_activity(df: DataFrame, source: str) -> DataFrame:
    """Add ``bad``: empty ids, another source, or no usable time."""
    good = (
        (F.length("activity_id") > 0)
        & (F.length("actor_key") > 0)
        & (F.length("actor_login") > 0)
        & (F.col("source") == source)
        & F.abs("published_ms").between(0, MAX_EXACT_INTEGER)
    )
    return df.withColumn("bad", ~F.coalesce(good, F.lit(False)))


def accepted_pages(df: DataFrame, source: str) -> DataFrame:
    """Per page: size, bad rows, acceptance. One bad row rejects the page."""
    return (
        check_activity(df, source)
        .groupBy("page")
        .agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("n_bad"))
        .withColumn("accepted", F.col("n_bad") == 0)
    )


def require_valid(df: DataFrame, source: str) -> DataFrame:
    """The page, or an error when any row is bad."""
    if check_activity(df, source).filter("bad").limit(1).count():
        raise RejectedLoad("activity page holds an invalid row")
    return df


def upsert_activity(store: DataFrame, page: DataFrame, revision: int) -> DataFrame:
    """Re-delivery takes the newest columns but keeps the first-seen revision.

    ``page`` holds one row per id.
    """
    old = store.alias("o").join(page.alias("p"), "activity_id", "full")
    columns = [c for c in page.columns if c != "activity_id"]
    arrived = F.col("p.source").isNotNull()
    picked = [F.when(arrived, F.col(f"p.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    first_seen = F.coalesce(F.col("o.inserted_revision"), F.lit(revision).cast("long"))
    return old.select("activity_id", *picked, first_seen.alias("inserted_revision"))


def actors_from_activity(actors: DataFrame, activity: DataFrame, order: str) -> DataFrame:
    """Activity creates unknown actors or fills a missing numeric id, nothing else."""
    first = (
        activity.groupBy("actor_key")
        .agg(F.min_by(F.struct("actor_id", "actor_login"), order).alias("_a"))
        .select("actor_key", "_a.actor_id", "_a.actor_login")
    )
    both = actors.alias("d").join(first.alias("f"), "actor_key", "full")
    known = F.col("d.login").isNotNull()
    keep = known & (F.col("d.id").isNotNull() | F.col("f.actor_id").isNull())
    return both.select(
        "actor_key",
        F.when(keep, F.col("d.id")).otherwise(F.col("f.actor_id")).alias("id"),
        F.when(keep, F.col("d.login")).otherwise(F.col("f.actor_login")).alias("login"),
        F.col("d.avatar_url").alias("avatar_url"),
    )


def actors_from_members(actors: DataFrame, members: DataFrame) -> DataFrame:
    """Follow lists are the display authority for a member and all its aliases."""
    named = members.select(
        F.explode(member_keys()).alias("actor_key"),
        F.struct("login", "actor_id", "avatar_url").alias("_m"),
    )
    shown = named.groupBy("actor_key").agg(F.max("_m").alias("_m"))
    both = actors.alias("d").join(shown.alias("s"), "actor_key", "full")
    listed = F.col("s._m").isNotNull()
    return both.select(
        "actor_key",
        F.when(listed, F.col("s._m.actor_id")).otherwise(F.col("d.id")).alias("id"),
        F.when(listed, F.col("s._m.login")).otherwise(F.col("d.login")).alias("login"),
        F.coalesce("s._m.avatar_url", "d.avatar_url").alias("avatar_url"),
    )
