"""Retention, log compaction, integrity audit and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators.ingest import append_changes
from rookery.operators.joins import split_join
from rookery.operators.ranking import top_n
from rookery.session import materialise

MAX_PER_ACTOR = 200
MAX_CHANGES_PER_USER = MAX_RECEIPTS_PER_USER = 2_000
PROOF_MAX_AGE_MS = 24 * 60 * 60 * 1000

_KEY = ["source", "activity_id"]


def _same_id(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


# Selection ---------------------------------------------------------------------


def over_limit(activity: DataFrame, n: int = MAX_PER_ACTOR) -> DataFrame:
    """Actors that hold more than ``n`` rows."""
    return activity.groupBy("actor_key").agg(F.count("*").alias("n")).filter(F.col("n") > n)


def cut_points(activity: DataFrame, n: int) -> DataFrame:
    """(actor_key, cut_ms, cut_id): the ``n``-th newest row of each actor that has one.

    The top-n keeps n rows per actor on the map side, so a huge actor never
    reaches one task whole.
    """
    newest = [F.desc("published_ms"), F.desc("activity_id")]
    keys = activity.select("actor_key", "published_ms", "activity_id")
    return (
        top_n(keys.filter(F.col("actor_key") != ""), ["actor_key"], newest, n, "_n")
        .filter(F.col("_n") == n)
        .select(
            "actor_key",
            F.col("published_ms").alias("cut_ms"),
            F.col("activity_id").alias("cut_id"),
        )
    )


def split_retained(activity: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``removed``: true below the cut point of the actor."""
    below = (F.col("published_ms") < F.col("cut_ms")) | (
        (F.col("published_ms") == F.col("cut_ms")) & (F.col("activity_id") < F.col("cut_id"))
    )
    return (
        split_join(activity, cuts, ["actor_key"], "left")
        .withColumn("removed", F.coalesce(below, F.lit(False)))
        .drop("cut_ms", "cut_id")
    )


def retain_newest(activity: DataFrame, n: int = MAX_PER_ACTOR) -> DataFrame:
    marked = split_retained(activity, cut_points(activity, n))
    return marked.filter(~F.col("removed")).drop("removed")


def oldest_by_actor(activity: DataFrame) -> DataFrame:
    """Earliest publication per actor, id as tie-break."""
    first = F.min(F.struct("published_ms", "activity_id"))
    return (
        activity.filter(F.col("actor_key") != "")
        .groupBy("actor_key")
        .agg(first.alias("_o"))
        .select(
            "actor_key",
            F.col("_o.published_ms").alias("oldest_ms"),
            F.col("_o.activity_id").alias("oldest_id"),
        )
    )


def orphan_floor(changes: DataFrame, activity: DataFrame) -> DataFrame:
    """Highest sequence per actor among log rows without an activity."""
    return (
        changes.filter(F.col("actor_key") != "")
        .join(activity.select(*_KEY), _KEY, "left_anti")
        .groupBy("actor_key")
        .agg(F.max("seq").alias("floor_seq"))
    )


# Audit -------------------------------------------------------------------------


def audit(activity: DataFrame, changes: DataFrame, retention: DataFrame) -> DataFrame:
    """Five integrity counts and ``ready`` in one row."""
    a = activity.select(*_KEY, F.col("actor_key").alias("a_key"), F.col("actor_id").alias("a_id"))
    c = changes.select(
        *_KEY, F.col("actor_key").alias("c_key"), F.col("actor_id").alias("c_id"), "seq"
    )
    stored, logged = F.col("a_key").isNotNull(), F.col("seq").isNotNull()
    differs = (F.col("a_key") != F.col("c_key")) | ~_same_id(F.col("a_id"), F.col("c_id"))
    pairs = a.join(c, _KEY, "full").agg(
        F.count_if(F.col("a_key") == "").alias("unnormalised"),
        F.count_if(stored & ~logged).alias("without_change"),
        F.count_if(stored & logged & differs).alias("mismatched"),
        F.count_if(logged & ~stored).alias("orphans"),
        F.lit(0).cast("long").alias("without_retention"),
    )
    zero = F.lit(0).cast("long")
    actors = actors_without_retention(activity, retention).agg(
        zero.alias("unnormalised"),
        zero.alias("without_change"),
        zero.alias("mismatched"),
        zero.alias("orphans"),
        F.count("*").alias("without_retention"),
    )
    counts = ["unnormalised", "without_change", "mismatched", "orphans", "without_retention"]
    whole = pairs.unionByName(actors).agg(*[F.sum(c).alias(c) for c in counts])
    total = sum((F.col(c) for c in counts), F.lit(0))
    return whole.withColumn("ready", total == 0)


def actors_without_retention(activity: DataFrame, retention: DataFrame) -> DataFrame:
    keys = activity.filter(F.col("actor_key") != "").select("actor_key").distinct()
    return keys.join(retention.select("actor_key"), "actor_key", "left_anti")


def gate(state: DataFrame, now_ms: int) -> DataFrame:
    """Add ``open``: a proof exists, is fresh enough and belongs to the epoch.

    ``state``: (data_epoch, proof_epoch, reconciled_ms, cleanup_enabled_ms).
    """
    fresh = F.col("reconciled_ms") >= now_ms - PROOF_MAX_AGE_MS
    enabled = F.col("cleanup_enabled_ms").isNotNull()
    same = F.col("data_epoch") == F.col("proof_epoch")
    return state.withColumn("open", F.coalesce(fresh & enabled & same, F.lit(False)))


# Repair ------------------------------------------------------------------------


def normalise_keys(activity: DataFrame, users: DataFrame) -> DataFrame:
    """Fill blank actor keys from the account table."""
    known = users.select(F.col("login").alias("actor_login"), F.col("id").alias("_id"))
    blank = F.col("actor_key") == ""
    alias = F.concat(F.lit("legacy-atom-login:"), F.lower("actor_login"))
    key = F.coalesce(F.concat(F.lit("github:"), F.col("_id")), alias)
    return (
        activity.join(known, "actor_login", "left")
        .withColumn("actor_id", F.when(blank, F.col("_id")).otherwise(F.col("actor_id")))
        .withColumn("actor_key", F.when(blank, key).otherwise(F.col("actor_key")))
        .drop("_id")
        .select(*activity.columns)
    )


def repair_changes(changes: DataFrame, activity: DataFrame) -> DataFrame:
    """Log rows take the keys of their activity; add ``repaired`` where they differed."""
    a = activity.select(
        *_KEY, F.col("actor_key").alias("a_key"), F.col("actor_id").alias("a_id")
    )
    matched = F.col("a_key").isNotNull()
    differs = (F.col("a_key") != F.col("actor_key")) | ~_same_id(F.col("a_id"), F.col("actor_id"))
    fixed = F.coalesce(matched & differs, F.lit(False))
    return (
        changes.join(a, _KEY, "left")
        .withColumn("repaired", fixed)
        .withColumn("actor_key", F.when(fixed, F.col("a_key")).otherwise(F.col("actor_key")))
        .withColumn("actor_id", F.when(fixed, F.col("a_id")).otherwise(F.col("actor_id")))
        .select(*changes.columns, "repaired")
    )


def sequence_missing(activity: DataFrame, changes: DataFrame, stored_head: int = 0) -> DataFrame:
    """Log rows for activities that have none, in (created, id) order.

    The activities without a log row are found first and written, so that copies,
    order and sequence are a matter of these few rows.
    """
    rows = activity.filter(F.col("actor_key") != "")
    missing = rows.select(*_KEY, "actor_key", "actor_id", "created_ms").join(
        changes.select(*_KEY), _KEY, "left_anti"
    )
    return append_changes(changes, materialise(missing, "missing"), stored_head)


def upsert_retention(retention: DataFrame, activity: DataFrame) -> DataFrame:
    """Current oldest marks; unknown actors start at floor 0, generation 0."""
    now = oldest_by_actor(activity).alias("n")
    both = retention.alias("r").join(now, "actor_key", "full")
    stored = F.col("n.oldest_id").isNotNull()
    return both.select(
        "actor_key",
        F.coalesce("r.compacted_through_seq", F.lit(0).cast("long")).alias("compacted_through_seq"),
        F.coalesce("r.retention_generation", F.lit(0).cast("long")).alias("retention_generation"),
        F.when(stored, F.col("n.oldest_ms")).otherwise(F.col("r.oldest_ms")).alias("oldest_ms"),
        F.when(stored, F.col("n.oldest_id")).otherwise(F.col("r.oldest_id")).alias("oldest_id"),
    )


def _raise_floors(retention: DataFrame, floors: DataFrame, oldest: DataFrame) -> DataFrame:
    """Floor = max, generation + 1 and fresh oldest marks for the actors in ``floors``."""
    marks = oldest.withColumnsRenamed({"oldest_ms": "_ms", "oldest_id": "_id"})
    touched = floors.join(marks, "actor_key", "left").withColumn("_hit", F.lit(True)).alias("t")
    both = retention.alias("r").join(touched, "actor_key", "full")
    hit = F.coalesce("t._hit", F.lit(False))
    old_floor = F.coalesce("r.compacted_through_seq", F.lit(0).cast("long"))
    return both.select(
        "actor_key",
        F.greatest(old_floor, F.coalesce("t.floor_seq", F.lit(0).cast("long"))).alias(
            "compacted_through_seq"
        ),
        (F.coalesce("r.retention_generation", F.lit(0).cast("long")) + hit.cast("long")).alias(
            "retention_generation"
        ),
        F.when(hit, F.col("t._ms")).otherwise(F.col("r.oldest_ms")).alias("oldest_ms"),
        F.when(hit, F.col("t._id")).otherwise(F.col("r.oldest_id")).alias("oldest_id"),
    )


def drop_orphans(
    changes: DataFrame, activity: DataFrame, retention: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(log without orphans, retention with raised floors).

    Orphans with a blank key stay, and keep the audit from passing. Log and activity
    meet once; the orphans are written and the log is read without their keys.
    """
    orphans = changes.select(*_KEY, "actor_key", "seq").join(activity.select(*_KEY), _KEY, "left_anti")
    orphans = materialise(orphans, "orphans")
    floors = (
        orphans.filter(F.col("actor_key") != "")
        .groupBy("actor_key")
        .agg(F.max("seq").alias("floor_seq"))
    )
    # A missing part of a key equals nothing: such a row is an orphan, though no join finds it.
    whole = F.col(_KEY[0]).isNotNull() & F.col(_KEY[1]).isNotNull()
    blank = F.col("actor_key") == ""
    gone = orphans.select(*_KEY).distinct().withColumn("_gone", F.lit(True))
    log = (
        changes.join(gone, _KEY, "left")
        .filter((whole & F.col("_gone").isNull()) | blank)
        .select(*changes.columns)
    )
    return log, _raise_floors(retention, floors, oldest_by_actor(activity))


def retention_run(
    activity: DataFrame, changes: DataFrame, retention: DataFrame, n: int = MAX_PER_ACTOR
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(activity, log, retention) after keeping the newest ``n`` rows of every actor.

    The cut points and the keys of removed rows are written once and used for all
    three results. A cut row is the oldest one its actor keeps.
    """
    cuts = materialise(cut_points(activity, n), "cuts")
    marked = split_retained(activity, cuts)
    kept = marked.filter(~F.col("removed")).drop("removed")
    gone = materialise(marked.filter("removed").select("actor_key", *_KEY), "removed")
    floors = (
        gone.join(changes.select(*_KEY, "seq"), _KEY, "left")
        .groupBy("actor_key")
        .agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("floor_seq"))
    )
    log = changes.join(gone.select(*_KEY), _KEY, "left_anti")
    oldest = cuts.withColumnsRenamed({"cut_ms": "oldest_ms", "cut_id": "oldest_id"})
    return kept, log, _raise_floors(retention, floors, oldest)


# User-state log ----------------------------------------------------------------


def nth_newest(log: DataFrame, n: int = MAX_CHANGES_PER_USER) -> DataFrame:
    """Compaction floor per user: the newest sequence that no longer fits in ``n``."""
    ranked = top_n(log.select("user_id", "seq"), ["user_id"], [F.desc("seq")], n + 1, "_n")
    return ranked.filter(F.col("_n") == n + 1).select("user_id", F.col("seq").alias("floor_seq"))


def newest_receipts(receipts: DataFrame, n: int = MAX_RECEIPTS_PER_USER) -> DataFrame:
    newest = [F.desc("created_ms"), F.desc("attempt_id")]
    return top_n(receipts, ["user_id"], newest, n)


def compact(
    log: DataFrame,
    receipts: DataFrame,
    floors: DataFrame,
    n_changes: int = MAX_CHANGES_PER_USER,
    n_receipts: int = MAX_RECEIPTS_PER_USER,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, receipts, floors) after compaction; ``floors``: (user_id, floor_seq)."""
    new = nth_newest(log, n_changes).withColumnRenamed("floor_seq", "_new")
    raised = floors.join(new, "user_id", "left").select(
        "user_id",
        F.greatest("floor_seq", F.coalesce("_new", "floor_seq")).alias("floor_seq"),
    )
    kept = (
        split_join(log, raised, ["user_id"], "left")
        .filter(F.col("seq") > F.coalesce("floor_seq", F.lit(0)))
        .drop("floor_seq")
    )
    return kept, newest_receipts(receipts, n_receipts), raised
