"""One actor holds a third of all rows: joins on it are split at run time."""

import pytest
from pyspark.sql import functions as F

from rookery.operators import feed, ingest, replication, retention
from rookery.session import tune

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def hot(spark):
    tune(spark)
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    n = F.col("id")
    rows = spark.range(0, 60_000, 1, 16).select(
        F.concat(F.lit("a"), n).alias("activity_id"),
        F.lit("s").alias("source"),
        F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), n % 997)).alias("actor_key"),
        F.when(n % 2 == 0, "push").otherwise("star").alias("type"),
        (n % 5000).alias("published_ms"),
        n.alias("seq"),
        (n % 50 == 0).alias("hidden"),
    )
    yield rows
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    collected = df.groupBy().count()
    collected.collect()
    return collected._jdf.queryExecution().executedPlan().toString()


def test_retention_splits_the_hot_actor(hot):
    kept = retention.retain_newest(hot, 30)
    assert "skew=true" in final_plan(kept)
    counts = {r["actor_key"]: r["count"] for r in kept.groupBy("actor_key").count().collect()}
    assert counts["hot"] == 30 and max(counts.values()) == 30


def test_fan_out_to_viewers_splits_the_hot_actor(spark, hot):
    bounds = spark.range(40).select(
        (F.col("id") % 8).cast("int").alias("viewer_id"),
        F.when(F.col("id") < 8, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        F.lit(0).cast("long").alias("from_seq"),
    )
    log = hot.select("seq", "source", "activity_id", "actor_key")
    read = replication.scoped_changes(log, hot, bounds)
    assert "skew=true" in final_plan(read)
    assert read.filter("key = 'hot'").count() == 8 * hot.filter("actor_key = 'hot' and not hidden and seq > 0").count()


def test_popular_account_is_split(spark, hot):
    """Follow edges are hot on the account; the stats are aggregated by it."""
    stats = feed.stats_by(hot, "actor_key")
    edges = hot.select(F.col("seq").cast("int").alias("viewer_id"), F.col("actor_key").alias("key"), "actor_key")
    folded = feed.summary_by_member(stats, edges)
    assert "skew=true" in final_plan(folded)
    assert folded.count() == 60_000


def test_hot_user_is_split_in_compaction(spark, hot):
    log = hot.select(F.col("actor_key").alias("user_id"), "seq", "activity_id")
    receipts = hot.select(
        F.col("actor_key").alias("user_id"), F.col("activity_id").alias("attempt_id"), F.col("seq").alias("created_ms")
    )
    floors = log.select("user_id").distinct().withColumn("floor_seq", F.lit(0).cast("long"))
    kept, newest, _ = retention.compact(log, receipts, floors, 20, 10)
    assert "skew=true" in final_plan(kept)
    for rows, most in ((kept, 20), (newest, 10)):
        assert rows.groupBy("user_id").count().agg(F.max("count")).first()[0] == most


def test_a_copied_id_does_not_reach_the_join(spark, hot):
    """A third of the delivery are copies of one id."""
    batch = hot.select(
        F.when(F.col("actor_key") == "hot", F.lit("copy")).otherwise(F.col("activity_id")).alias("activity_id"),
        F.col("published_ms").alias("created_ms"),
        "published_ms",
    )
    new = ingest.ingest_activity(batch.filter("activity_id = 'a1'"), batch)
    assert new.count() == 40_000
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Anti") < plan.index("WindowGroupLimit")
