"""Connected components of a graph given as links, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.operators.joins import split_join
from rookery.session import materialise


def _stars(links: DataFrame, downward: bool) -> DataFrame:
    """Each node's neighbours tied to the least of them: the larger neighbours
    (``downward`` false) or the node with its smaller ones."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if downward:
        near = links.filter("a > b").unionByName(turned.filter("a > b"))
    else:
        near = links.unionByName(turned)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = split_join(near, least, ["a"])
    if downward:
        tied = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    else:
        tied = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of the links (long columns ``a`` and ``b``);
    a component is named by its least node.

    Rounds of large and small stars until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Each round is written to the shared
    folder, which cuts the lineage. Hubs are summed before they are shuffled and their
    joins can be split. Links of a node with itself say nothing; no links, no rows.
    """
    mark = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0).cast("long")))
    links = links.filter("a <> b").select("a", "b").distinct()
    before = None
    while True:
        links = materialise(_stars(_stars(links, False), True), "stars")
        now = links.select(mark).first()[0]
        if now == before:
            break
        before = now
    named = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = named.select("component").distinct()
    return named.unionByName(roots.select(F.col("component").alias("node"), "component"))
