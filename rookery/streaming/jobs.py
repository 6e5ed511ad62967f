"""Bounded streaming runs over append-only folders.

Each run reads what is new up to a fixed upper bound (``availableNow``) and ends.
Every micro-batch writes to a folder named by its batch id, in overwrite mode, so
a batch that is replayed after a failure replaces itself: exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery import schemas
from rookery.operators import feed, ingest
from rookery.operators.joins import split_join
from rookery.streaming import mutations


def _read_before(
    spark: SparkSession, path: str, schema: T.StructType, batch_id: int
) -> DataFrame:
    """What earlier batches wrote; this batch's own folder is left out."""
    wide = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        found = spark.read.schema(wide).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # only an absent table is empty
            raise
        found = spark.createDataFrame([], wide)
    return found.filter(F.col("batch_id") < batch_id).drop("batch_id")


def read_all(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _read_before(spark, path, schema, 2**62)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_available(source: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything that is there now, then stop."""
    query = (
        source.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_ingest(
    source: DataFrame, store: str, checkpoint: str, known: str | None = None
) -> None:
    """Append activities whose id was never stored, over any number of deliveries.

    The dedupe is an anti-join against the store, not stream state, so it has no
    horizon and no growing state store. ``known`` names a finished store of
    another consumer, whose rows count as stored.
    """
    schema = source.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known_rows = _read_before(spark, store, schema, batch_id)
        if known:
            known_rows = known_rows.unionByName(read_all(spark, known, schema))
        _write(ingest.ingest_activity(known_rows, batch), store, batch_id)

    run_available(source, checkpoint, each)


STATS = T.StructType(
    [
        T.StructField("actor_key", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("latest_ms", T.LongType()),
    ]
)


def stream_stats(source: DataFrame, deltas: str, checkpoint: str) -> None:
    """Per (actor, type) partial aggregates of each batch; merging is a sum and a max."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _write(feed.stats_by(feed.base(batch), "actor_key", "type"), deltas, batch_id)

    run_available(source, checkpoint, each)


def merged_stats(spark: SparkSession, deltas: str, *keys: str) -> DataFrame:
    """Current aggregates at ``keys`` from all batches so far."""
    return (
        read_all(spark, deltas, STATS)
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.max("latest_ms").alias("latest_ms"))
    )


MEMBER_STATS = T.StructType(
    [
        T.StructField("viewer_id", T.IntegerType()),
        T.StructField("member_key", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("latest_ms", T.LongType()),
    ]
)
MEMBERSHIP = T.StructType(
    [
        T.StructField("viewer_id", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("actor_key", T.StringType()),
    ]
)


def _last_update(spark: SparkSession, root: str) -> tuple[int, int]:
    """Number of the last update of the member level, and the batch it went through."""
    marks = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("through", T.LongType())])
    try:
        found = spark.read.schema(marks).parquet(f"{root}/updates").agg(F.max(F.struct("batch_id", "through")).alias("u"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, -1
    last = found.first().u
    return (last.batch_id, last.through) if last else (0, -1)


def stream_levels(source: DataFrame, membership: DataFrame, root: str, checkpoint: str) -> None:
    """Statistics of a growing activity by (actor, type) and by member of every viewer.

    Batches write partial aggregates of accounts. After a run the member level is brought
    up to date under ``membership`` (viewer_id, key, actor_key): only members with new
    activity, or who gained or lost a key since the last update, are summed anew, from
    the cells of their accounts; who has none left gets a row that takes the old one back.
    An update that fails is made up for by the next one; its folder is then replaced.
    """
    spark = source.sparkSession
    stream_stats(source, f"{root}/deltas", checkpoint)
    done, through = _last_update(spark, root)
    wide = T.StructType([*STATS.fields, T.StructField("batch_id", T.LongType())])
    deltas = spark.read.schema(wide).parquet(f"{root}/deltas")
    head = deltas.agg(F.max("batch_id")).first()[0]
    head = through if head is None else max(head, through)
    active = deltas.filter(F.col("batch_id") > through).select(F.col("actor_key").alias("key")).distinct()

    now = membership.select(*MEMBERSHIP.names).distinct()
    _write(now, f"{root}/membership", done + 1)
    now = spark.read.schema(MEMBERSHIP).parquet(f"{root}/membership/batch_id={done + 1}")
    before = spark.createDataFrame([], MEMBERSHIP)
    if done:
        before = spark.read.schema(MEMBERSHIP).parquet(f"{root}/membership/batch_id={done}")
    side = lambda df, name: df.withColumn("_side", F.lit(name))
    moved = (
        side(before, 1).unionByName(side(now, 2)).groupBy(*MEMBERSHIP.names).agg(F.sum("_side").alias("_in")).filter("_in < 3")
    )
    member = F.col("actor_key").alias("member_key")
    touched = (
        moved.select("viewer_id", member).unionByName(now.join(active, "key", "left_semi").select("viewer_id", member)).distinct()
    )
    cells = merged_stats(spark, f"{root}/deltas", "actor_key").withColumnRenamed("actor_key", "key")
    keys = now.select("viewer_id", "key", member).join(touched, ["viewer_id", "member_key"], "left_semi")
    sums = (
        split_join(keys, cells, ["key"])
        .groupBy("viewer_id", "member_key")
        .agg(F.sum("n").alias("n"), F.max("latest_ms").alias("latest_ms"))
    )
    fresh = touched.join(sums, ["viewer_id", "member_key"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    _write(fresh.select(*MEMBER_STATS.names), f"{root}/members", done + 1)
    mark = spark.createDataFrame([(head,)], "through long")
    _write(mark.coalesce(1), f"{root}/updates", done + 1)


def member_stats(spark: SparkSession, root: str) -> DataFrame:
    """Current member level: the last row of each member that has any activity."""
    done, _ = _last_update(spark, root)
    wide = T.StructType([*MEMBER_STATS.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(wide).parquet(f"{root}/members").filter(F.col("batch_id") <= done)
    newest = rows.groupBy("viewer_id", "member_key").agg(F.max_by(F.struct("n", "latest_ms"), "batch_id").alias("_s"))
    return newest.filter("_s.n > 0").select("viewer_id", "member_key", "_s.n", "_s.latest_ms")


def changes_since(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Change log as a stream: read by arrival of log files, not by publication time."""
    reader = spark.readStream.schema(schemas.ACTIVITY_CHANGE)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def stream_mutations(
    source: DataFrame, root: str, checkpoint: str, receipt_ms: int = mutations.RECEIPT_MS
) -> None:
    """Outcomes of mutation deliveries, written to ``{root}/results``.

    Versions, tombstones and receipts live in the state store beside the checkpoint; a
    stopped stream goes on from there. Arrival numbers grow across deliveries.
    """

    def each(outcomes: DataFrame, batch_id: int) -> None:
        _write(outcomes, f"{root}/results", batch_id)

    run_available(mutations.mutation_outcomes(source, receipt_ms), checkpoint, each)
