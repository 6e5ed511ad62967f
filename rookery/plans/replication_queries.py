"""History, delta, gap recovery, coverage and scope transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import identity, ingest
from rookery.operators import coverage as C
from rookery.operators import replication as P
from rookery.plans.catalog import query
from rookery.plans.identity_queries import positions
from rookery.sources import tables as T


def _keys(spark: SparkSession, sf_dir: str, revision: str) -> DataFrame:
    members = T.members(spark, sf_dir).filter(F.col("revision") == revision)
    return identity.scope_keys(members).drop("revision")


def _viewer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, T.ACTIVE).filter(F.col("viewer_id") == T.VIEWER)


T.VIEW_SQL["logged"] = """
 select c.seq, c.source, c.activity_id, c.actor_key as change_key, a.actor_key, a.hidden, a.published_ms, a.type
 from activity_change c join activity a on a.source = c.source and a.activity_id = c.activity_id"""
_SCOPE = "(select key from membership where revision = 'r2' and viewer_id = 3)"


@query("select seq, activity_id, change_key, actor_key, published_ms from logged")
def changes_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.changes_with_rows(T.activity_change(spark, sf_dir), T.activity(spark, sf_dir))
    return rows.select("seq", "activity_id", "change_key", "actor_key", "published_ms")


# Pages go up to the head of the log, and deltas begin half-way.
_HEAD = "(select max(seq) from activity_change)"
_HALF = "(select max(seq) // 2 from activity_change)"


def _head(spark: SparkSession, sf_dir: str) -> int:
    return ingest.head_seq(T.activity_change(spark, sf_dir))


_HISTORY = f"select seq, activity_id, published_ms from logged where not hidden and seq <= {_HEAD} and actor_key in {_SCOPE} order by published_ms desc, activity_id desc limit 51"


@query(_HISTORY)
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = P.history_page(
        T.activity_change(spark, sf_dir), T.activity(spark, sf_dir), _viewer_keys(spark, sf_dir), _head(spark, sf_dir), 50
    )
    return page.select("seq", "activity_id", "published_ms")


@query(
    f"""select seq, activity_id, published_ms from logged where not hidden and seq <= {_HEAD} and actor_key in {_SCOPE}
    and (published_ms < 1705276800000 or (published_ms = 1705276800000 and activity_id < 'tag:feed,2024:m'))
    order by published_ms desc, activity_id desc limit 51"""
)
def history_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = P.history_page(
        T.activity_change(spark, sf_dir),
        T.activity(spark, sf_dir),
        _viewer_keys(spark, sf_dir),
        _head(spark, sf_dir),
        50,
        after=(1705276800000, "tag:feed,2024:m"),
    )
    return page.select("seq", "activity_id", "published_ms")


@query(
    f"""select seq, activity_id, published_ms from logged where not hidden and seq > {_HALF} and seq <= {_HEAD} and change_key in {_SCOPE}
    order by seq, activity_id limit 51"""
)
def delta_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _head(spark, sf_dir)
    page = P.delta_page(
        T.activity_change(spark, sf_dir), T.activity(spark, sf_dir), _viewer_keys(spark, sf_dir), head // 2, head, 50
    )
    return page.select("seq", "activity_id", "published_ms")


@query(
    f"""select seq, activity_id, published_ms from logged where not hidden and (seq > {_HALF} + 100 or (seq = {_HALF} + 100 and activity_id > 'tag'))
    and seq <= {_HEAD} and change_key in {_SCOPE} order by seq, activity_id limit 51"""
)
def delta_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _head(spark, sf_dir)
    page = P.delta_page(
        T.activity_change(spark, sf_dir),
        T.activity(spark, sf_dir),
        _viewer_keys(spark, sf_dir),
        head // 2,
        head,
        50,
        after=(head // 2 + 100, "tag"),
    )
    return page.select("seq", "activity_id", "published_ms")


@query(
    """select p.viewer_id, count(*) as n, min(l.seq) as first_seq, max(l.seq) as last_seq from logged l
    join membership m on m.key = l.change_key and m.revision = 'r2'
    join (select n_nationkey as viewer_id, cast(n_nationkey % 7 as bigint) * 700 as from_seq from nation) p on p.viewer_id = m.viewer_id
    where not l.hidden and l.seq > p.from_seq group by p.viewer_id"""
)
def delta_all_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every viewer's replica is missing, each from its own position."""
    bounds = _keys(spark, sf_dir, T.ACTIVE).join(positions(spark, sf_dir, 700), "viewer_id")
    rows = P.scoped_changes(T.activity_change(spark, sf_dir), T.activity(spark, sf_dir), bounds)
    return rows.groupBy("viewer_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


T.VIEW_SQL["gap_plan"] = """
 select v.viewer_id, case when count(r.actor_key) > 0 then 'history' else 'delta' end as action,
  case when count(r.actor_key) > 0 then 0 else v.from_seq end as from_seq
 from (select n_nationkey as viewer_id, cast(n_nationkey % 7 as bigint) * 40 as from_seq from nation) v
 left join membership s on s.viewer_id = v.viewer_id and s.revision = 'r2'
 left join retention r on r.actor_key = s.key and r.compacted_through_seq > v.from_seq
 group by v.viewer_id, v.from_seq"""


@query(
    f"""select g.viewer_id, g.action, count(l.seq) as n_rows, {_HEAD} as checkpoint_seq from gap_plan g
    left join membership m on m.viewer_id = g.viewer_id and m.revision = 'r2'
    left join logged l on l.change_key = m.key and not l.hidden and l.seq > g.from_seq and l.seq <= {_HEAD}
    group by g.viewer_id, g.action"""
)
def recover_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a gap: replay history, then the checkpoint is whole again."""
    keys = _keys(spark, sf_dir, T.ACTIVE)
    gaps = identity.gap_floor(positions(spark, sf_dir), keys, T.retention(spark, sf_dir))
    return P.recover_gap(
        T.activity_change(spark, sf_dir), T.activity(spark, sf_dir), keys, gaps, _head(spark, sf_dir)
    )


@query(
    f"""select n.viewer_id, l.activity_id, l.seq, o.key is not null as held from membership n
    join (select n_nationkey as viewer_id, cast(n_nationkey % 7 as bigint) * 700 as from_seq from nation) p on p.viewer_id = n.viewer_id
    left join membership o on o.viewer_id = n.viewer_id and o.revision = 'r1' and o.key = n.key
    join logged l on l.change_key = n.key and not l.hidden and l.seq <= {_HEAD}
     and l.seq > case when o.key is null then 0 else p.from_seq end
    where n.revision = 'r2'"""
)
def scope_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move of every viewer from revision r1 to r2: drain kept keys, backfill added ones."""
    return P.scope_transition(
        T.activity_change(spark, sf_dir),
        T.activity(spark, sf_dir),
        _keys(spark, sf_dir, T.PREVIOUS),
        _keys(spark, sf_dir, T.ACTIVE),
        positions(spark, sf_dir, 700),
        _head(spark, sf_dir),
    )


T.VIEW_SQL["page_event"] = """
 select user_id as scope, event_id as pos, case event_type when 'error' then 'gap' when 'view' then 'history' when 'click' then 'history' else 'delta' end as kind,
  event_id % 3 = 0 as is_end from events"""


@query(
    """select scope,
     case when max(pos) filter (kind <> 'delta') is null then 'unchecked'
      when max(pos) filter (kind = 'history' and is_end) = max(pos) filter (kind <> 'delta') then 'exhausted' else 'may-have-more' end as remote_window,
     case when coalesce(max(pos) filter (kind = 'gap'), -1) > coalesce(max(pos) filter (kind = 'history' and is_end), -1) then 'gap-detected' else 'continuous' end as integrity
    from page_event group by scope"""
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = (
        F.when(kind == "error", "gap").when(kind.isin("view", "click"), "history").otherwise("delta")
    )
    events = T.read(spark, sf_dir, "events")
    return P.coverage(
        events.select(
            F.col("user_id").alias("scope"),
            F.col("event_id").alias("at"),
            outcome.alias("kind"),
            (F.col("event_id") % 3 == 0).alias("is_end"),
        )
    )


T.VIEW_SQL["page_read"] = """
 select user_id as scope, event_id as nth, case event_type when 'error' then 'gap' when 'purchase' then 'gap' when 'signup' then 'delta' else 'history' end as kind,
  event_id * 7 % 400 as low, event_id * 7 % 400 + event_id % 41 - 2 as high, event_id % 3 = 0 as is_end from events where user_id % 11 <> 5 or event_type <> 'view' and event_type <> 'click'"""


@query(
    """with recursive point as (select scope, kind, nth, unnest(range(low, high + 1)) as seq from page_read),
     state as (select scope, seq, max(nth) filter (kind <> 'gap') as read_at, max(nth) filter (kind = 'gap') as gap_at from point group by scope, seq),
     missing as (select scope, count(*) as n, min(seq) as first from state where gap_at > coalesce(read_at, -1) group by scope),
     known as (select scope, count(*) as n from state where read_at is not null group by scope)
    select f.scope, case when f.has_history then 'initialized' else 'pending' end as bootstrap,
     case when not f.has_history then 'unchecked' when f.last_end then 'exhausted' else 'may-have-more' end as remote_window,
     case when m.n > 0 then 'gap-detected' else 'continuous' end as integrity, coalesce(k.n, 0) as n_covered, coalesce(m.n, 0) as n_missing, m.first as first_missing
    from (select scope, bool_or(kind = 'history') as has_history, arg_max(is_end, nth) filter (kind = 'history') as last_end from page_read group by scope) f
    left join missing m on m.scope = f.scope left join known k on k.scope = f.scope"""
)
def coverage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all scopes from overlapping windows; the twin looks at every sequence."""
    n, kind = F.col("event_id"), F.col("event_type")
    outcome = F.when(kind.isin("error", "purchase"), C.GAP).when(kind == "signup", C.DELTA).otherwise(C.HISTORY)
    events = T.read(spark, sf_dir, "events").filter((F.col("user_id") % 11 != 5) | ~kind.isin("view", "click"))
    return C.coverage_facts(
        events.select(
            F.col("user_id").alias("scope"),
            n.alias("at"),
            outcome.alias("kind"),
            (n * 7 % 400).alias("low"),
            (n * 7 % 400 + n % 41 - 2).alias("high"),
            (n % 3 == 0).alias("is_end"),
        )
    )
