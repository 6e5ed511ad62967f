"""What is known of a log: intervals of sequences that were read, gaps that are still open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.joins import split_join

HISTORY, DELTA, GAP = "history", "delta", "gap"


def union_of(intervals: DataFrame, *group: str) -> DataFrame:
    """(group, low, high): overlapping or adjacent intervals of a group as one.

    Ends are included; an interval whose end lies before its start is empty.
    """
    # Of intervals with one start only the longest matters: summed before the window.
    longest = intervals.filter("low <= high").groupBy(*group, "low").agg(F.max("high").alias("high"))
    order = Window.partitionBy(*group).orderBy("low")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("low") > before + 1, F.lit(True)).cast("int")
    numbered = longest.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
    return numbered.groupBy(*group, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def difference_of(intervals: DataFrame, taken: DataFrame, *group: str) -> DataFrame:
    """(group, low, high): what of the one interval of each group no interval of ``taken``
    has. Both are (group, low, high); ``taken`` may have any number for a group."""
    whole = intervals.select(*group, F.col("low").alias("_low"), F.col("high").alias("_high"))
    rest = split_join(whole, union_of(taken, *group), list(group), "left")
    inside = rest.withColumns({"_there": F.col("low").isNotNull(), "low": F.greatest("low", "_low"), "high": F.least("high", "_high")})
    there = F.col("_there") & (F.col("low") <= F.col("high"))
    cut = F.when(there, F.struct("low", "high"))
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_last("_cut"))
    placed = inside.withColumn("_cut", cut).filter("_low <= _high").withColumns(
        {
            "_last": F.coalesce(
                F.last("_cut.high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_low") - 1
            ),
            "_more": F.lead("_cut").over(order).isNotNull(),
        }
    )
    # Before each cut from the end of the one before, and after the last one.
    first = F.struct((F.col("_last") + 1).alias("low"), F.coalesce(F.col("_cut.low") - 1, F.col("_high")).alias("high"))
    tail = F.struct((F.col("_cut.high") + 1).alias("low"), F.col("_high").alias("high"))
    after = F.when(F.col("_cut").isNotNull() & ~F.col("_more"), tail)
    holes = placed.select(*group, F.explode(F.array(first, after)).alias("_hole"))
    found = holes.select(*group, "_hole.low", "_hole.high").filter("low <= high")
    return union_of(found, *group)


def open_gaps(events: DataFrame) -> DataFrame:
    """(scope, low, high): sequences that a gap was reported for and no later read covers.

    ``events``: (scope, at, kind, low, high), ``at`` distinct within a scope.
    """
    gaps = events.filter(F.col("kind") == GAP).select("scope", F.col("at").alias("gap_at"), "low", "high")
    reads = events.filter(F.col("kind").isin(HISTORY, DELTA)).select(
        "scope", "at", F.col("low").alias("from"), F.col("high").alias("to")
    )
    heals = split_join(gaps, reads, ["scope"]).filter("at > gap_at and `from` <= high and to >= low")
    taken = heals.select("scope", "gap_at", F.col("from").alias("low"), F.col("to").alias("high"))
    return union_of(difference_of(gaps, taken, "scope", "gap_at"), "scope")


def covered(events: DataFrame) -> DataFrame:
    """(scope, low, high): sequences that history or delta pages have read."""
    return union_of(events.filter(F.col("kind").isin(HISTORY, DELTA)).select("scope", "low", "high"), "scope")


def coverage_facts(events: DataFrame) -> DataFrame:
    """Facts of every scope: (scope, bootstrap, remote_window, integrity, n_covered,
    n_missing, first_missing).

    ``events``: (scope, at, kind, low, high, is_end) of pages and gaps. A scope is
    initialised by its first history page; its window is exhausted if the last history
    page was the end; it is continuous once later reads cover every sequence of its gaps,
    however many windows that takes. Scopes without pages or gaps have no row.
    """
    history = F.col("kind") == HISTORY
    facts = events.groupBy("scope").agg(
        F.coalesce(F.bool_or(history), F.lit(False)).alias("_read"),
        F.max_by("is_end", F.when(history, F.col("at"))).alias("_end"),
    )
    length = F.sum(F.col("high") - F.col("low") + 1)
    known = covered(events).groupBy("scope").agg(length.alias("n_covered"))
    missing = open_gaps(events).groupBy("scope").agg(length.alias("n_missing"), F.min("low").alias("first_missing"))
    found = facts.join(known, "scope", "left").join(missing, "scope", "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "scope",
        F.when(F.col("_read"), "initialized").otherwise("pending").alias("bootstrap"),
        F.when(~F.col("_read"), "unchecked").when(F.col("_end"), "exhausted").otherwise("may-have-more").alias("remote_window"),
        F.when(F.col("n_missing") > 0, "gap-detected").otherwise("continuous").alias("integrity"),
        F.coalesce("n_covered", zero).alias("n_covered"),
        F.coalesce("n_missing", zero).alias("n_missing"),
        "first_missing",
    )
