"""Exact global and per-group row numbers without an un-partitioned window,
and top-n selections whose map side keeps at most n rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.joins import split_join
from rookery.session import materialise

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row index below


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """0-based position of every row in the total order ``order``.

    Range partitions keep any hot key or time spread over tasks; each task
    numbers its own sorted rows and the partition sizes give the offsets. Only
    one count per partition reaches the driver. The ranged rows are written
    once, so a lost executor cannot change the partition borders.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pinned = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _LOCAL_BITS)
    sizes = pinned.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    offsets, start = [], 0
    for size in sizes:
        offsets.append((size["_part"], start))
        start += size["count"]
    spark = df.sparkSession
    # One row per partition: safe to broadcast at any data size.
    table = F.broadcast(spark.createDataFrame(offsets, "_part long, _start long"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        pinned.withColumn("_part", part)
        .join(table, "_part")
        .withColumn(name, F.col("_start") + local)
        .drop("_part", "_start", "_at")
    )


def numbered_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """0-based position inside each group; a group may exceed any one task.

    Group columns are not null.
    """
    ranked = numbered(df, [*[F.col(g) for g in group], *order], "_global")
    # ``numbered`` already wrote its rows, so both uses read the same table.
    first = ranked.groupBy(*group).agg(F.min("_global").alias("_first"))
    return (
        split_join(ranked, first, group)
        .withColumn(name, F.col("_global") - F.col("_first"))
        .drop("_global", "_first")
        .select(*df.columns, name)
    )


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str | None = None
) -> DataFrame:
    """First ``n`` rows per group. Catalyst limits each map task to n rows per group."""
    window = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n)
    return out.withColumnRenamed("_n", name) if name else out.drop("_n")


def first_by(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return top_n(df, group, order, 1)


def last_by(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group, by partial aggregation."""
    rest = [c for c in df.columns if c not in group]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*group).agg(picked).select(*group, "_row.*").select(*df.columns)


def top_with_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows up to the ``n``-th largest ``by``, ties included.

    The n-th largest value comes from a top-n sort of one column; the rows are
    then picked by comparing with it.
    """
    if n <= 0:
        return df.limit(0)
    cut = df.select(F.col(by).alias("_v")).orderBy(F.desc("_v")).limit(n)
    return df.filter(F.col(by) >= cut.agg(F.min("_v")).scalar())
