"""Clearing a user's feed as compare-and-set, and the log of a user's state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.values import clamp
from rookery.operators.joins import split_join
from rookery.operators.ranking import numbered_within

CLEAR_RESULT = (
    "user_id {kind}, arrival long, mutation_id string, attempt_id string, outcome string, "
    "cleared_ms long, version long, stepped boolean"
)
FEED, FILTER = "feed-state", "filter"


def _cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clears in order of arrival, each user led by what is known. Attempts are kept only
    where ``asked`` says that they come again."""
    user, cleared, version = None, None, 0
    took: set[str] = set()
    started = False
    for batch in batches:
        places, out = [], []
        columns = (c.to_pylist() for c in batch.columns)
        for place, (owner, arrival, mutation, attempt, base, at, kind, asked) in enumerate(zip(*columns, strict=True)):
            if not started or owner != user:
                started, user, cleared, version, took = True, owner, None, 0, set()
            if kind == "state":
                cleared, version = at, base
                continue
            if kind == "receipt":
                took.add(attempt)
                continue
            stepped = False
            if attempt in took:
                outcome = "already-applied"
            elif base == version:
                stepped = cleared is None or at > cleared
                outcome, version = "applied", version + stepped
                cleared = at if stepped else cleared
                if asked:
                    took.add(attempt)
            else:
                outcome = "conflict"
            places.append(place)
            out.append((arrival, mutation, attempt, outcome, cleared, version, stepped))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        rows = list(zip(*out, strict=True)) or [()] * len(kinds)
        arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
        names = ["user_id", "arrival", "mutation_id", "attempt_id", "outcome", "cleared_ms", "version", "stepped"]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *arrays], names)


def apply_clears(
    log: DataFrame, state: DataFrame, receipts: DataFrame, now_ms: int
) -> DataFrame:
    """Outcome of every clear: (user_id, arrival, mutation_id, attempt_id, outcome,
    cleared_ms, version, stepped).

    ``log``: (user_id, arrival, mutation_id, attempt_id, base_version, anchor_ms,
    candidate_ms), arrivals distinct per user and not negative. A clear applies when its
    base is the user's version; a user without a row has version 0. Its time is the
    candidate between anchor and now, or now without an anchor. The watermark never goes
    back, and the version steps only when it moves, so a clear may apply without a step.
    ``state``: (user_id, cleared_ms, version); ``receipts``: (user_id, attempt_id) applied
    earlier. A NULL attempt is never a repeat; no rows give no rows.
    """
    now = F.lit(now_ms).cast("long")
    time = F.when(F.col("anchor_ms").isNotNull(), clamp(F.col("candidate_ms"), F.col("anchor_ms"), now)).otherwise(now)
    key = ["user_id", "attempt_id"]
    sent = log.filter("attempt_id is not null").groupBy(*key).agg(F.count("*").alias("_n"))
    again = sent.filter("_n > 1").select(*key, F.lit(True).alias("asked"))
    rows = split_join(log, again, key, "left").select(
        "user_id", "arrival", "mutation_id", "attempt_id", "base_version", time.alias("at"),
        F.lit("clear").alias("kind"), F.coalesce("asked", F.lit(False)).alias("asked"),
    )
    none, lead, no = F.lit(None).cast("string"), F.lit(-1).cast("long"), F.lit(False)
    users = log.select("user_id").distinct()
    known = state.join(users, "user_id", "left_semi").select(
        "user_id", lead.alias("arrival"), none.alias("mutation_id"), none.alias("attempt_id"),
        F.col("version").alias("base_version"), F.col("cleared_ms").alias("at"), F.lit("state").alias("kind"), no.alias("asked"),
    )
    used = receipts.select(*key).join(sent.select(*key), key, "left_semi").select(
        "user_id", lead.alias("arrival"), none.alias("mutation_id"), "attempt_id",
        lead.alias("base_version"), lead.alias("at"), F.lit("receipt").alias("kind"), no.alias("asked"),
    )
    ordered = (
        rows.unionByName(known).unionByName(used).repartition("user_id").sortWithinPartitions("user_id", "arrival")
    )
    kind = log.schema["user_id"].dataType.simpleString()
    return ordered.mapInArrow(_cleared, CLEAR_RESULT.format(kind=kind))


def feed_states(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(user_id, cleared_ms, version, last_attempt_id) after the clears of a delivery."""
    newest = F.max_by(F.struct("cleared_ms", "version", "attempt_id"), "arrival").alias("_row")
    moved = outcomes.filter("outcome = 'applied'").groupBy("user_id").agg(newest)
    both = state.join(moved, "user_id", "full")
    return both.select(
        "user_id",
        F.coalesce("_row.cleared_ms", "cleared_ms").alias("cleared_ms"),
        F.coalesce("_row.version", "version").alias("version"),
        F.col("_row.attempt_id").alias("last_attempt_id"),
    )


def state_changes(filters: DataFrame, clears: DataFrame) -> DataFrame:
    """Changes that outcomes make: (user_id, entity_kind, entity_id, version, arrival).

    ``filters``: outcomes of mutations with ``user_id``. A clear that moved no watermark
    changes nothing, nor do repeats and conflicts.
    """
    puts = filters.filter("outcome = 'applied'").select(
        "user_id", F.lit(FILTER).alias("entity_kind"), F.col("entity_id").cast("string").alias("entity_id"), "version", "arrival"
    )
    moved = clears.filter("outcome = 'applied' and stepped").select(
        "user_id", F.lit(FEED).alias("entity_kind"), F.lit("feed").alias("entity_id"), "version", "arrival"
    )
    return puts.unionByName(moved)


def write_state_log(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Log rows to append: (user_id, seq, entity_kind, entity_id, version, arrival).

    Sequences follow the head of each user without a gap, in order of arrival. A change
    that the log holds (by user, entity and version) gives no row, so a delivery that is
    written again appends nothing; a change that comes twice in one delivery counts once.
    """
    key = ["user_id", "entity_kind", "entity_id", "version"]
    fresh = changes.groupBy(*key).agg(F.min("arrival").alias("arrival"))
    fresh = split_join(fresh, log.select(*key).withColumn("_held", F.lit(True)), key, "left").filter("_held is null")
    order = [F.col("arrival"), F.col("entity_kind"), F.col("entity_id"), F.col("version")]
    placed = numbered_within(fresh.drop("_held"), ["user_id"], order, "_nth")
    heads = log.groupBy("user_id").agg(F.max("seq").alias("_head"))
    found = split_join(placed, heads, ["user_id"], "left")
    seq = F.coalesce("_head", F.lit(0).cast("long")) + F.col("_nth") + 1
    return found.select("user_id", seq.alias("seq"), *key[1:], "arrival")
