"""Streaming runs, projection generations and the maintenance run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery import schemas
from rookery.operators import extract, identity, ingest, projection, retention
from rookery.operators import rules as R
from rookery.plans import maintenance
from rookery.plans.catalog import query
from rookery.plans.identity_queries import _xor_sql
from rookery.plans.ingest_queries import raw_following
from rookery.plans.retention_queries import receipts, state_log
from rookery.plans.rule_queries import SAMPLE_RULES, membership, user_filter
from rookery.plans.state_queries import _AGGREGATES, _FOLD
from rookery.session import scratch_path
from rookery.sources import tables as T
from rookery.sources.store import Store, maintain_generation
from rookery.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table as a file stream."""
    schema = T.read(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}*.parquet")


@query("select activity_id, actor_key, published_ms from activity")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole activity stream delivered twice; the store holds each row once."""
    root = scratch_path(spark, "ingest")
    source = T.activity_of(_stream(spark, sf_dir, "events"))
    jobs.stream_ingest(source, f"{root}/store", f"{root}/first")
    # A second consumer starts from scratch: its batch ids start over, so it
    # writes to its own folder behind the first store.
    twice = source.withColumn("created_ms", F.col("created_ms") + 1)
    jobs.stream_ingest(twice, f"{root}/again", f"{root}/second", known=f"{root}/store")
    stored = jobs.read_all(spark, f"{root}/store", source.schema)
    late = jobs.read_all(spark, f"{root}/again", source.schema)
    return stored.unionByName(late).select("activity_id", "actor_key", "published_ms")


@query(
    "select actor_key, type, count(*) as n, max(published_ms) as latest_ms from activity where not hidden group by actor_key, type"
)
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "stats")
    jobs.stream_stats(
        T.activity_of(_stream(spark, sf_dir, "events")), f"{root}/deltas", f"{root}/checkpoint"
    )
    return jobs.merged_stats(spark, f"{root}/deltas", "actor_key", "type")


@query(
    """select 'actor_type' as level, null as viewer_id, actor_key, type, count(*) as n, max(published_ms) as latest_ms from activity where not hidden group by actor_key, type
    union all select 'type', null, null, type, count(*), max(published_ms) from activity where not hidden group by type
    union all select 'member', m.viewer_id, m.actor_key, null, count(*), max(a.published_ms) from activity a
     join membership m on m.key = a.actor_key and m.revision = 'r2' where not a.hidden group by m.viewer_id, m.actor_key"""
)
def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of statistics over two deliveries, between which follow lists change."""
    root = scratch_path(spark, "levels")
    rows = T.activity(spark, sf_dir)
    half = ingest.head_seq(rows) // 2
    for revision, part in ((T.PREVIOUS, F.col("seq") <= half), (T.ACTIVE, F.col("seq") > half)):
        rows.filter(part).write.mode("append").parquet(f"{root}/inbox")
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/inbox")
        jobs.stream_levels(source, membership(spark, sf_dir, revision), root, f"{root}/checkpoint")
    none = F.lit(None)
    levels = [
        jobs.merged_stats(spark, f"{root}/deltas", "actor_key", "type").select(
            F.lit("actor_type").alias("level"), none.cast("int").alias("viewer_id"), "actor_key", "type", "n", "latest_ms"
        ),
        jobs.merged_stats(spark, f"{root}/deltas", "type").select(
            F.lit("type").alias("level"), none.cast("int").alias("viewer_id"), none.cast("string").alias("actor_key"), "type", "n", "latest_ms"
        ),
        jobs.member_stats(spark, root).select(
            F.lit("member").alias("level"), "viewer_id", F.col("member_key").alias("actor_key"), none.cast("string").alias("type"), "n", "latest_ms"
        ),
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


@query(
    """select actor_key, count(*) as n, max(seq) as last_seq, count(distinct case when seq <= (select max(seq) // 2 from activity_change) then 0 else 1 end) as n_runs
    from activity_change group by actor_key"""
)
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bounded runs over a growing log: each delivers what the run before did not."""
    root = scratch_path(spark, "changes")
    log = T.activity_change(spark, sf_dir).select(*schemas.ACTIVITY_CHANGE.names)

    def run(name: str):
        def each(batch: DataFrame, batch_id: int) -> None:
            counts = batch.groupBy("actor_key").agg(
                F.count("*").alias("n"), F.max("seq").alias("last_seq")
            )
            counts.write.mode("overwrite").parquet(f"{root}/out/{name}-{batch_id}")

        jobs.run_available(jobs.changes_since(spark, f"{root}/log"), f"{root}/checkpoint", each)

    half = ingest.head_seq(log) // 2
    log.filter(F.col("seq") <= half).write.mode("append").parquet(f"{root}/log")
    run("a")
    log.filter(F.col("seq") > half).write.mode("append").parquet(f"{root}/log")
    run("b")
    delivered = spark.read.schema("actor_key string, n long, last_seq long").parquet(f"{root}/out/*")
    return delivered.groupBy("actor_key").agg(
        F.sum("n").alias("n"), F.max("last_seq").alias("last_seq"), F.count("*").alias("n_runs")
    )


@query(
    f"{_FOLD} select entity_id, arrival, mutation_id, attempt_id, outcome, version, deleted from fold where step > 0"
)
def stream_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries of turns, the stream being started anew for each."""
    root = scratch_path(spark, "mutations")
    log = T.mutations(spark, sf_dir).select(*schemas.MUTATION.names)
    for low, high in ((0, 2), (3, 4), (5, None)):
        later = F.col("arrival") >= low
        part = log.filter(later if high is None else later & (F.col("arrival") <= high))
        part.write.mode("append").parquet(f"{root}/inbox")
        source = spark.readStream.schema(schemas.MUTATION).parquet(f"{root}/inbox")
        jobs.stream_mutations(source, root, f"{root}/checkpoint")
    return jobs.read_all(spark, f"{root}/results", schemas.MUTATION_RESULT)


# Projections -------------------------------------------------------------------


def _membership_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = T.members(spark, sf_dir).filter(F.col("revision") == T.ACTIVE)
    return identity.membership_signature(active, ["viewer_id"])


_CANONICAL = ", ".join(
    "({}, '{}')".format(i, R.canonical_text(text).replace("'", "''"))
    for i, (text, sql) in enumerate(SAMPLE_RULES)
    if sql is not None
)
_PAIR = r"""concat('"', key, '\u0000', actor_key, '"')"""


@query(
    f"""select coalesce(m.viewer_id, r.viewer_id) as viewer_id,
     sha256(concat(coalesce(r.sig, 'none'), '|', coalesce(m.sig, 'none'), '|{extract.HTML_CLEANER.version}')) as signature
    from (select viewer_id, {_xor_sql("line")} as sig from (
      select viewer_id, actor_key, concat('[', string_agg({_PAIR}, ',' order by key), ']') as line
      from membership where revision = 'r2' group by viewer_id, actor_key) group by viewer_id) m
    full join (select viewer_id, {_xor_sql("concat('rule', f.rule_ix, ':', c.text)")} as sig from user_filter f
      join (values {_CANONICAL}) c(rule_ix, text) on c.rule_ix = f.rule_ix where not f.deleted group by viewer_id) r on r.viewer_id = m.viewer_id"""
)
def projection_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.signatures(
        user_filter(spark, sf_dir),
        _membership_signatures(spark, sf_dir),
        extract.HTML_CLEANER.version,
    )


@query(_AGGREGATES)
def projection_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build up to one revision, extend to the head; the result equals a full build."""
    store = Store(spark, scratch_path(spark, "projection"))
    rows, texts = T.activity(spark, sf_dir), R.rules_of(user_filter(spark, sf_dir), T.VIEWER)
    keys = membership(spark, sf_dir)

    def between(low: int, high: int) -> DataFrame:
        part = rows.filter((F.col("seq") > low) & (F.col("seq") <= high))
        return projection.aggregates(projection.facts(part, keys, T.VIEWER, texts))

    head = rows.agg(F.max("seq")).first()[0]
    for through in (head // 2, head, head):
        maintain_generation(
            store, "projection", "s1", through, lambda high: between(0, high), between,
            projection.merge_aggregates,
        )
    return store.read("projection")


# Maintenance -------------------------------------------------------------------


T.VIEW_SQL["refresh_outcome"] = """
 select event_type as step, concat('user', user_id) as subject, event_id % 7 <> 0 as ok, event_id % 5 as items from events"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return T.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("step"),
        F.concat(F.lit("user"), F.col("user_id")).alias("subject"),
        (n % 7 != 0).alias("ok"),
        (n % 5).alias("items"),
    )


@query(
    """select step, count(*) as attempted, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed, cast(sum(items) as bigint) as items
    from refresh_outcome group by step"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.run_summary(_outcomes(spark, sf_dir), "step")


@query(
    """select 'start' as event, null as subject, count(*) + (select count(*) from github_user where id is null) as items from refresh_outcome
    union all select case when ok then 'success' else 'error' end, subject, items from refresh_outcome
    union all select 'done', null, count(*) filter (not ok) from refresh_outcome"""
)
def refresh_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = T.github_user(spark, sf_dir).filter(F.col("id").isNull())
    return maintenance.progress(_outcomes(spark, sf_dir), skipped)


_KEEP = 60
T.VIEW_SQL["document_activity"] = """
 select case when doc_id % 4 <> 0 then concat('github:', doc_id % 150) when u.id is not null then concat('github:', u.id)
  else concat('legacy-atom-login:user', doc_id % 150) end as actor_key
 from documents left join github_user u on u.login = concat('user', doc_id % 150)"""


@query(
    f"""select 'following' as step, true as ok, count(*) as items, '' as message from (
      select distinct viewer_id, lower(login) from raw_following r where not exists (select 1 from raw_following b where b.viewer_id = r.viewer_id and b.login = 'bad login'))
    union all select 'reconcile', true, 0, 'clean'
    union all select 'refresh', true, count(*), '' from documents
    union all select 'cleanup', true, cast(sum(greatest(n - {_KEEP}, 0)) as bigint), '' from (
      select actor_key, count(*) as n from (select actor_key from activity union all select actor_key from document_activity) group by actor_key)
    union all select 'compact', true, count(*), '' from (select row_number() over (partition by user_id order by seq desc) as n from state_log) where n <= 25"""
)
def maintenance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maintenance steps over the whole tables, from a log with planted defects."""
    store = Store(spark, scratch_path(spark, "maintenance"))
    stored = T.activity(spark, sf_dir).withColumn("link", F.lit(None).cast("string"))
    empty_marks = spark.createDataFrame([], schemas.RETENTION)
    store.publish(
        {
            "activity": stored.select(*schemas.ACTIVITY.names),
            "change": T.activity_change(spark, sf_dir).select(*schemas.ACTIVITY_CHANGE.names),
            "retention": empty_marks,
        }
    )
    users = T.github_user(spark, sf_dir)

    def compact() -> int:
        everyone = T.github_user(spark, sf_dir).select(
            F.col("login").alias("user_id"), F.lit(0).cast("long").alias("floor_seq")
        )
        log, kept, raised = retention.compact(
            state_log(spark, sf_dir), receipts(spark, sf_dir), everyone, 25, 10
        )
        store.publish({"state_log": log, "receipt": kept, "state_floor": raised})
        return store.read("state_log").count()

    outcomes = maintenance.run_maintenance(
        spark,
        {
            "following": lambda: maintenance.sync_following(store, raw_following(spark, sf_dir), T.NOW_MS),
            "reconcile": lambda: maintenance.reconcile_if_needed(store, users, T.NOW_MS),
            "refresh": lambda: maintenance.refresh(
                store, T.raw_feed(spark, sf_dir), users, "feed-v1", T.NOW_MS
            ),
            "cleanup": lambda: maintenance.cleanup(store, _KEEP, T.NOW_MS),
            "compact": compact,
        },
    )
    return outcomes.select("step", "ok", "items", "message")
