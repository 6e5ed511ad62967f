"""Retention, audit, repair and log compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import retention as K
from rookery.plans.catalog import query
from rookery.sources import tables as T

N = 40  # rows kept per actor in the sample runs

T.VIEW_SQL["aged"] = f"""
 select *, row_number() over (partition by actor_key order by published_ms desc, activity_id desc) > {N} as removed from activity"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention table with oldest marks not yet known."""
    return T.retention(spark, sf_dir).select(
        "actor_key",
        "compacted_through_seq",
        "retention_generation",
        F.lit(None).cast("long").alias("oldest_ms"),
        F.lit(None).cast("string").alias("oldest_id"),
    )


@query("select activity_id, actor_key, published_ms from aged where not removed")
def retain_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.activity(spark, sf_dir).select("activity_id", "actor_key", "published_ms")
    return K.retain_newest(rows, N)


@query(f"select actor_key, count(*) as n from activity group by actor_key having count(*) > {N}")
def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.over_limit(T.activity(spark, sf_dir), N)


_OLDEST = """select actor_key, published_ms as oldest_ms, activity_id as oldest_id from (
 select *, row_number() over (partition by actor_key order by published_ms, activity_id) as n from {0}) where n = 1"""


@query(_OLDEST.format("activity"))
def oldest_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.oldest_by_actor(T.activity(spark, sf_dir))


_ORPHAN = "not exists (select 1 from activity a where a.source = c.source and a.activity_id = c.activity_id)"


@query(f"select actor_key, max(seq) as floor_seq from activity_change c where {_ORPHAN} group by actor_key")
def orphan_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.orphan_floor(T.activity_change(spark, sf_dir), T.activity(spark, sf_dir))


@query(
    """select actor_key, count(*) as n from activity a where exists (
     select 1 from activity_change c where c.source = a.source and c.activity_id = a.activity_id) group by actor_key"""
)
def change_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities that the log holds, by actor."""
    log = T.activity_change(spark, sf_dir).select("source", "activity_id")
    held = T.activity(spark, sf_dir).join(log, ["source", "activity_id"], "left_semi")
    return held.groupBy("actor_key").agg(F.count("*").alias("n"))


@query(
    """select activity_id, actor_key from activity a where not exists (
     select 1 from activity_change c where c.source = a.source and c.activity_id = a.activity_id)"""
)
def missing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.activity_change(spark, sf_dir).select("source", "activity_id")
    lost = T.activity(spark, sf_dir).join(log, ["source", "activity_id"], "left_anti")
    return lost.select("activity_id", "actor_key")


# The audited activity table has blank keys and misses some retention rows.
T.VIEW_SQL["dented"] = """
 select * replace (case when (seq - 1) % 211 = 0 then '' else actor_key end as actor_key) from activity"""
T.VIEW_SQL["known_mark"] = "select * from retention where length(actor_key) <> 9"


def _dented(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = (F.col("seq") - 1) % 211 == 0
    return T.activity(spark, sf_dir).withColumn(
        "actor_key", F.when(blank, F.lit("")).otherwise(F.col("actor_key"))
    )


_AUDIT = """
 select (select count(*) from dented where actor_key = '') as unnormalised,
  (select count(*) from dented a where not exists (select 1 from activity_change c where c.source = a.source and c.activity_id = a.activity_id)) as without_change,
  (select count(*) from activity_change c join dented a on a.source = c.source and a.activity_id = c.activity_id
   where a.actor_key <> c.actor_key or coalesce(a.actor_id, '') <> coalesce(c.actor_id, '')) as mismatched,
  (select count(*) from activity_change c where not exists (select 1 from dented a where a.source = c.source and a.activity_id = c.activity_id)) as orphans,
  (select count(distinct actor_key) from dented a where actor_key <> '' and not exists (select 1 from known_mark r where r.actor_key = a.actor_key)) as without_retention,
  false as ready"""


@query(_AUDIT)
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.retention(spark, sf_dir).filter(F.length("actor_key") != 9)
    return K.audit(_dented(spark, sf_dir), T.activity_change(spark, sf_dir), known)


@query(
    "select distinct actor_key from activity a where not exists (select 1 from known_mark r where r.actor_key = a.actor_key)"
)
def actors_without_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.retention(spark, sf_dir).filter(F.length("actor_key") != 9)
    return K.actors_without_retention(T.activity(spark, sf_dir), known)


@query("select activity_id, actor_key, actor_id from activity")
def normalise_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank keys come back from the account table."""
    fixed = K.normalise_keys(_dented(spark, sf_dir), T.github_user(spark, sf_dir))
    return fixed.select("activity_id", "actor_key", "actor_id")


@query(
    """select c.seq, c.activity_id, coalesce(a.actor_key, c.actor_key) as actor_key,
     a.actor_key is not null and a.actor_key <> c.actor_key as repaired
    from activity_change c left join activity a on a.source = c.source and a.activity_id = c.activity_id"""
)
def repair_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = K.repair_changes(T.activity_change(spark, sf_dir), T.activity(spark, sf_dir))
    return fixed.select("seq", "activity_id", "actor_key", "repaired")


@query(
    """select (select max(seq) from activity_change) + row_number() over (order by created_ms, activity_id) as seq, activity_id, actor_key
    from dented a where actor_key <> '' and not exists (
     select 1 from activity_change c where c.source = a.source and c.activity_id = a.activity_id)"""
)
def sequence_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = K.sequence_missing(_dented(spark, sf_dir), T.activity_change(spark, sf_dir))
    return new.select("seq", "activity_id", "actor_key")


@query(
    f"""select o.actor_key, coalesce(r.compacted_through_seq, 0) as compacted_through_seq,
     coalesce(r.retention_generation, 0) as retention_generation, o.oldest_ms, o.oldest_id
    from ({_OLDEST.format("activity")}) o left join known_mark r on r.actor_key = o.actor_key"""
)
def upsert_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = marks(spark, sf_dir).filter(F.length("actor_key") != 9)
    return K.upsert_retention(known, T.activity(spark, sf_dir))


@query(
    f"""select coalesce(r.actor_key, f.actor_key) as actor_key,
     greatest(coalesce(r.compacted_through_seq, 0), coalesce(f.floor_seq, 0)) as compacted_through_seq,
     coalesce(r.retention_generation, 0) + case when f.actor_key is null then 0 else 1 end as retention_generation, o.oldest_id
    from retention r full join (select actor_key, max(seq) as floor_seq from activity_change c where {_ORPHAN} group by actor_key) f on f.actor_key = r.actor_key
    left join ({_OLDEST.format("activity")}) o on o.actor_key = f.actor_key"""
)
def drop_orphans_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors and generations after orphan log rows are dropped."""
    _, floors = K.drop_orphans(
        T.activity_change(spark, sf_dir), T.activity(spark, sf_dir), marks(spark, sf_dir)
    )
    return floors.drop("oldest_ms")


@query(f"select seq, activity_id from activity_change c where not {_ORPHAN}")
def drop_orphans_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = K.drop_orphans(
        T.activity_change(spark, sf_dir), T.activity(spark, sf_dir), marks(spark, sf_dir)
    )
    return log.select("seq", "activity_id")


_GONE = "select g.actor_key, max(c.seq) as floor_seq from aged g left join activity_change c on c.source = g.source and c.activity_id = g.activity_id where g.removed group by g.actor_key"


@query(
    f"""select r.actor_key, greatest(r.compacted_through_seq, coalesce(f.floor_seq, 0)) as compacted_through_seq,
     r.retention_generation + case when f.actor_key is null then 0 else 1 end as retention_generation, o.oldest_ms, o.oldest_id
    from retention r left join ({_GONE}) f on f.actor_key = r.actor_key
    left join ({_OLDEST.format("(select * from aged where not removed)")}) o on o.actor_key = f.actor_key"""
)
def retention_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors, generations and oldest marks after one retention run over all actors."""
    _, _, floors = K.retention_run(
        T.activity(spark, sf_dir), T.activity_change(spark, sf_dir), marks(spark, sf_dir), N
    )
    return floors


@query(
    """select c.seq, c.activity_id from activity_change c where not exists (
     select 1 from aged g where g.removed and g.source = c.source and g.activity_id = c.activity_id)"""
)
def retention_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log, _ = K.retention_run(
        T.activity(spark, sf_dir), T.activity_change(spark, sf_dir), marks(spark, sf_dir), N
    )
    return log.select("seq", "activity_id")


@query(
    """select event_id as shard, event_id % 4 <> 3 and event_id % 3 <> 2 and event_id % 2 = 0 and event_id % 20 < 12 as open from events"""
)
def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-up gate of many shards: proof present, fresh, and of the same epoch."""
    n = F.col("event_id")
    age = F.when(n % 20 < 12, F.lit(1000)).otherwise(F.lit(2 * T.DAY_MS))
    state = T.read(spark, sf_dir, "events").select(
        n.alias("shard"),
        F.lit("e1").alias("data_epoch"),
        F.when(n % 3 == 2, "e0").otherwise("e1").alias("proof_epoch"),
        F.when(n % 4 != 3, F.lit(T.NOW_MS) - age).alias("reconciled_ms"),
        F.when(n % 2 == 0, F.lit(T.NOW_MS)).alias("cleanup_enabled_ms"),
    )
    return K.gate(state, T.NOW_MS).select("shard", "open")


# User-state log: one user per login, entities by type.
T.VIEW_SQL["state_log"] = "select actor_login as user_id, type as entity_id, seq from activity"
T.VIEW_SQL["receipt"] = "select actor_login as user_id, activity_id as attempt_id, published_ms as created_ms from activity"
T.VIEW_SQL["state_floor"] = "select login as user_id, created_ms % 900 as floor_seq from github_user where length(login) <> 5"


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.activity(spark, sf_dir).select(
        F.col("actor_login").alias("user_id"), F.col("type").alias("entity_id"), "seq"
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.activity(spark, sf_dir).select(
        F.col("actor_login").alias("user_id"),
        F.col("activity_id").alias("attempt_id"),
        F.col("published_ms").alias("created_ms"),
    )


def state_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = T.github_user(spark, sf_dir).filter(F.length("login") != 5)
    return users.select(F.col("login").alias("user_id"), (F.col("created_ms") % 900).alias("floor_seq"))


_NTH = "select user_id, max(seq) as floor_seq from (select *, row_number() over (partition by user_id order by seq desc) as n from state_log) where n > 25 group by user_id"


@query(_NTH)
def nth_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nth_newest(state_log(spark, sf_dir), 25)


@query(
    """select user_id, attempt_id from (select *, row_number() over (partition by user_id order by created_ms desc, attempt_id desc) as n from receipt) where n <= 10"""
)
def receipts_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.newest_receipts(receipts(spark, sf_dir), 10).select("user_id", "attempt_id")


@query(
    f"""select l.user_id, l.seq from state_log l
    left join (select f.user_id, greatest(f.floor_seq, coalesce(n.floor_seq, f.floor_seq)) as floor_seq from state_floor f left join ({_NTH}) n on n.user_id = f.user_id) f
     on f.user_id = l.user_id where l.seq > coalesce(f.floor_seq, 0)"""
)
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _, _ = K.compact(
        state_log(spark, sf_dir), receipts(spark, sf_dir), state_floors(spark, sf_dir), 25, 10
    )
    return log.select("user_id", "seq")


@query(
    f"select f.user_id, greatest(f.floor_seq, coalesce(n.floor_seq, f.floor_seq)) as floor_seq from state_floor f left join ({_NTH}) n on n.user_id = f.user_id"
)
def compact_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, floors = K.compact(
        state_log(spark, sf_dir), receipts(spark, sf_dir), state_floors(spark, sf_dir), 25, 10
    )
    return floors
