"""Mix documents of several sources to target weights.

Every document gets a hash-random key. Sorted by source and key, a source's
documents are laid end to end; distributed prefix sums of their sizes give each
one its place, and the mix takes each source up to its budget exactly: whole
epochs first, then a last part that ends inside one document. Key ranges of a
source are summed apart, so a source may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.common import WORD
from rookery.operators.ranking import numbered
from rookery.session import materialise

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken so many times at most.
MOST_EPOCHS = 3
#: Documents that one key range holds on average; each range is sorted in one task.
RANGE_ROWS = 4096
_KEY_DIGITS = 7


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """Words to take of each source: ``source, source_size, source_rows, target``.

    ``sizes`` has a row per document with ``source`` and ``size``. All sizes together
    are shared by weight; a source above ``most_epochs`` times its own size stops
    there and the excess goes to the others by weight, until none is above. One
    round is one aggregate over the sources, and every round but the last stops
    further sources. Sources rank by code point with null last.
    """
    each = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    ranked = numbered(each, [F.asc_nulls_last("source")], "rank")
    cycle = F.array(*map(F.lit, weights))
    weighted = ranked.withColumn(
        "weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")).cast("long")
    )
    limit = F.col("source_size") * most_epochs
    share, stopped = 0.0, -1
    while True:
        above = F.lit(share) * F.col("weight") > limit if stopped >= 0 else F.lit(False)
        row = weighted.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(above, 1)).alias("stopped"),
        ).first()
        if row["stopped"] == stopped:
            break
        stopped = row["stopped"]
        share = (row["total"] - row["fixed"]) / row["open"] if row["open"] else 0.0
    target = F.least(F.lit(share) * F.col("weight"), limit.cast("double"))
    return weighted.select("source", "source_size", "source_rows", target.alias("target"))


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row of ``docs``.

    ``size`` is the number of words, ``taken`` how many of them the mix takes over
    all epochs, ``copies`` in how many epochs the document starts. A source's taken
    words add up to its target rounded down. Null text: size 0, never taken; null
    source: a source of its own, last; null doc_id: its own key. Repeated rows count
    one by one; rows alike in id and size are exchangeable. No documents: no rows.
    Other columns are not looked at. The same rows give the same mix.
    """
    return _placed(docs, weights, most_epochs, seed).drop("row")


def repeated(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """The rows of ``docs``, with all columns, as often as the mix starts them. The last
    document of a source is taken whole; rows that the mix does not reach go."""
    placed = _placed(docs, weights, most_epochs, seed)
    # Equal rows are exchangeable: one of them stands for all their copies.
    copies = placed.groupBy("row").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _row().alias("row")
    )
    joined = packed.join(copies, "row").withColumn(
        "_n", F.row_number().over(Window.partitionBy("row").orderBy("copies"))
    )
    once = joined.filter("_n = 1")
    return once.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def _row() -> Column:
    """What tells rows apart."""
    return F.struct("doc_id", "source", F.xxhash64("text").alias("hash"))


def _placed(docs: DataFrame, weights: Sequence[int], most_epochs: int, seed: int) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    # Narrow rows, written once: the texts are read and counted a single time.
    rows = materialise(
        docs.select(
            _row().alias("row"),
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            key.alias("key"),
        ),
        "mix",
    )
    goal = targets(rows.select("source", "size"), weights, most_epochs)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / RANGE_ROWS))
    place = F.conv(F.substring("key", 1, _KEY_DIGITS), 16, 10).cast("long") / 16**_KEY_DIGITS
    # One row per source: joined to the rows without a limit on either side.
    placed = (
        rows.join(goal, rows["source"].eqNullSafe(goal["source"]))
        .drop(goal["source"])
        .withColumn("range", F.floor(place * ranges))
    )
    # Sums of the ranges of a source, then of the documents inside each range.
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_source"),
        F.col("range").alias("_range"),
        F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"),
    )
    inside = (
        Window.partitionBy("source", "range")
        .orderBy("key", "doc_id", "size", "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return (
        placed.join(
            starts,
            placed["source"].eqNullSafe(starts["_source"]) & (placed["range"] == starts["_range"]),
        )
        .withColumn("start", start)
        .select(
            "row",
            "doc_id",
            "size",
            "source_size",
            "target",
            (epochs * F.col("size") + part).cast("long").alias("taken"),
            F.when(F.col("size") > 0, epochs + (part > 0).cast("long"))
            .otherwise(0)
            .alias("copies"),
        )
    )
