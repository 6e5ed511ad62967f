"""Versioned user state and projection generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import clears, fold, ingest, merge, projection, state
from rookery.operators import rules as R
from rookery.plans.catalog import query
from rookery.plans.retention_queries import state_log
from rookery.plans.rule_queries import SAMPLE_RULES, membership, user_filter
from rookery.session import materialise
from rookery.sources import tables as T

# The fold as a recursion over arrivals, one step per turn.
T.VIEW_SQL["turn"] = "select *, row_number() over (partition by entity_id order by arrival) as step from mutation"
_FOLD = """with recursive fold as (
  select entity_id, cast(0 as bigint) as step, cast(0 as bigint) as version, false as deleted, cast([] as varchar[]) as applied,
   cast(null as bigint) as arrival, cast(null as varchar) as mutation_id, cast(null as varchar) as attempt_id, cast(null as varchar) as outcome
  from (select distinct entity_id from mutation)
  union all
  select entity_id, step, case when hit then version + 1 else version end, deleted or (hit and kind = 'delete'),
   case when hit then list_append(applied, attempt_id) else applied end, arrival, mutation_id, attempt_id,
   case when list_contains(applied, attempt_id) then 'already-applied' when hit then 'applied' else 'conflict' end
  from (select f.entity_id, t.step, f.version, f.deleted, f.applied, t.arrival, t.mutation_id, t.attempt_id, t.kind,
    not list_contains(f.applied, t.attempt_id) and not f.deleted and t.base_version = f.version and (t.kind = 'put' or f.version > 0) as hit
   from fold f join turn t on t.entity_id = f.entity_id and t.step = f.step + 1))"""


@query(
    f"{_FOLD} select entity_id, arrival, mutation_id, attempt_id, outcome, version, deleted from fold where step > 0"
)
def apply_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.apply_mutations(T.mutations(spark, sf_dir))


# The same log with bases that often match, so that chains, deletes and retries occur.
T.VIEW_SQL["dense_turn"] = """
 select event_id // 7 as entity_id, event_id as arrival, concat('m', event_id) as mutation_id,
  concat('a', case when event_id % 9 = 4 then event_id - 1 else event_id end) as attempt_id,
  case when event_id % 9 = 4 then (event_id - 1) % 7 % 4 else event_id % 7 % 4 end as base_version,
  case when event_id % 31 = 3 then 'delete' else 'put' end as kind, row_number() over (partition by event_id // 7 order by event_id) as step from events"""


@query(
    _FOLD.replace(" turn t", " dense_turn t").replace("from mutation)", "from dense_turn)")
    + " select entity_id, arrival, attempt_id, outcome, version, deleted from fold where step > 0"
)
def apply_dense_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.apply_mutations(_dense_log(spark, sf_dir)).drop("mutation_id")


def _dense_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    again = F.when(n % 9 == 4, n - 1).otherwise(n)
    return T.read(spark, sf_dir, "events").select(
        F.floor(n / 7).alias("entity_id"),
        n.alias("arrival"),
        F.concat(F.lit("m"), n).alias("mutation_id"),
        F.concat(F.lit("a"), again).alias("attempt_id"),
        (again % 7 % 4).alias("base_version"),
        F.when(n % 31 == 3, "delete").otherwise("put").alias("kind"),
    )


# From the fifth row of an entity on its receipts are gone: only its last attempt counts,
# until another mutation moves the entity.
_COMPACTED = """with recursive fold as (
  select entity_id, cast(0 as bigint) as step, cast(0 as bigint) as version, false as deleted, cast([] as varchar[]) as applied,
   cast(null as varchar) as kept, cast(null as bigint) as arrival, cast(null as varchar) as attempt_id, cast(null as varchar) as outcome
  from (select distinct entity_id from dense_turn)
  union all
  select entity_id, step, case when hit then version + 1 else version end, deleted or (hit and kind = 'delete'),
   case when hit then list_append(known, attempt_id) else known end, case when hit and arrival % 7 >= 4 then null else last end, arrival, attempt_id,
   case when again then 'already-applied' when hit then 'applied' else 'conflict' end
  from (select *, not again and not deleted and base_version = version and (kind = 'put' or version > 0) as hit
   from (select *, coalesce(list_contains(known, attempt_id) or last = attempt_id, list_contains(known, attempt_id)) as again
    from (select f.entity_id, t.step, f.version, f.deleted, t.arrival, t.attempt_id, t.base_version, t.kind,
      case when t.step = 5 then cast([] as varchar[]) else f.applied end as known,
      case when t.step = 5 then f.applied[len(f.applied)] else f.kept end as last
     from fold f join dense_turn t on t.entity_id = f.entity_id and t.step = f.step + 1))))"""


@query(f"{_COMPACTED} select entity_id, arrival, attempt_id, outcome, version, deleted from fold where step > 4")
def mutations_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries; between them the receipts are dropped and entity rows stay."""
    log = _dense_log(spark, sf_dir).withColumn("user_id", F.col("entity_id") % 97)
    early = F.col("arrival") % 7 < 4
    known = state.entity_rows(fold.apply_mutations(log.filter(early)))
    known = known.withColumn("user_id", F.col("entity_id") % 97)
    return fold.apply_mutations(log.filter(~early), known).drop("mutation_id")


@query(
    f"""{_FOLD} select s.entity_id, s.version, s.deleted, p.name, md5(p.value) as value_md5
    from (select entity_id, max(version) as version, bool_or(deleted) as deleted from fold where outcome = 'applied' group by entity_id) s
    left join (select f.entity_id, f.version, t.name, t.value from fold f join turn t on t.entity_id = f.entity_id and t.step = f.step
      where f.outcome = 'applied' and t.kind = 'put') p
     on p.entity_id = s.entity_id and p.version = s.version - case when s.deleted then 1 else 0 end"""
)
def entity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.mutations(spark, sf_dir)
    now = state.entity_state(fold.apply_mutations(log), log)
    return now.select("entity_id", "version", "deleted", "name", F.md5("value").alias("value_md5"))


@query(
    """select coalesce(s.viewer_id, c.user_id) as user_id, greatest(s.cleared_ms, c.best) as cleared_ms,
     cast(case when s.viewer_id is null then 0 else 1 end + case when c.best > coalesce(s.cleared_ms, -1) then 1 else 0 end as bigint) as version
    from feed_state s full join (
     select cast((seq - 1) % 25 as integer) as user_id,
      max(case when seq % 500 = 0 then 1706659200000 else least(1706659200000, greatest(published_ms - 86400000, created_ms + (seq % 9) * 86400000)) end) as best
     from activity group by 1) c on c.user_id = s.viewer_id"""
)
def advance_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear candidates of all users, clamped and merged into the watermarks."""
    n = F.col("seq") - 1
    candidates = (
        T.activity(spark, sf_dir)
        .select(
            (n % 25).cast("int").alias("user_id"),
            F.when(F.col("seq") % 500 != 0, F.col("published_ms") - T.DAY_MS).alias("anchor_ms"),
            (F.col("created_ms") + (F.col("seq") % 9) * T.DAY_MS).alias("candidate_ms"),
        )
    )
    known = T.feed_state(spark, sf_dir).select(
        F.col("viewer_id").alias("user_id"), "cleared_ms", F.lit(1).cast("long").alias("version")
    )
    return state.advance_watermark(known, candidates, T.NOW_MS)


# Clears of five hundred users and more: twenty rows each, bases that often match, retries.
T.VIEW_SQL["clear_turn"] = """
 select (seq - 1) // 20 as user_id, seq - 1 as arrival, concat('c', case when (seq - 1) % 9 = 4 then seq - 2 else seq - 1 end) as attempt_id,
  (seq - 1) % 20 // 2 as base_version, row_number() over (partition by (seq - 1) // 20 order by seq) as step,
  case when (seq - 1) % 50 = 0 then 1706659200000 else least(1706659200000, greatest(published_ms - 86400000, created_ms + (seq % 9) * 86400000)) end as cand
 from activity"""
T.VIEW_SQL["clear_known"] = "select distinct (seq - 1) // 20 as user_id, cast(1704500000000 as bigint) as cleared_ms, cast(1 as bigint) as version from activity where (seq - 1) // 20 % 7 = 3"
_CLEARS = """with recursive clear as (
  select u.user_id, cast(0 as bigint) as step, k.cleared_ms, coalesce(k.version, 0) as version, cast([] as varchar[]) as applied,
   cast(null as bigint) as arrival, cast(null as varchar) as attempt_id, cast(null as varchar) as outcome, false as stepped
  from (select distinct user_id from clear_turn) u left join clear_known k on k.user_id = u.user_id
  union all
  select user_id, step, case when hit and grew then cand else cleared_ms end, case when hit and grew then version + 1 else version end,
   case when hit then list_append(applied, attempt_id) else applied end, arrival, attempt_id,
   case when again then 'already-applied' when hit then 'applied' else 'conflict' end, hit and grew
  from (select *, not again and base_version = version as hit, cleared_ms is null or cand > cleared_ms as grew
   from (select c.user_id, t.step, c.cleared_ms, c.version, c.applied, t.arrival, t.attempt_id, t.base_version, t.cand,
     list_contains(c.applied, t.attempt_id) as again
    from clear c join clear_turn t on t.user_id = c.user_id and t.step = c.step + 1)))"""


def _clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq") - 1
    rows = T.activity(spark, sf_dir)
    log = rows.select(
        F.floor(n / 20).alias("user_id"),
        n.alias("arrival"),
        F.concat(F.lit("m"), n).alias("mutation_id"),
        F.concat(F.lit("c"), F.when(n % 9 == 4, n - 1).otherwise(n)).alias("attempt_id"),
        F.floor(n % 20 / 2).alias("base_version"),
        F.when(n % 50 != 0, F.col("published_ms") - T.DAY_MS).alias("anchor_ms"),
        (F.col("created_ms") + (F.col("seq") % 9) * T.DAY_MS).alias("candidate_ms"),
    )
    user = F.floor(n / 20)
    known = rows.filter(user % 7 == 3).select(user.alias("user_id")).distinct()
    known = known.withColumns({"cleared_ms": F.lit(1704500000000).cast("long"), "version": F.lit(1).cast("long")})
    none = spark.createDataFrame([], "user_id long, attempt_id string")
    return clears.apply_clears(log, known, none, T.NOW_MS)


@query(f"{_CLEARS} select user_id, arrival, attempt_id, outcome, cleared_ms, version, stepped from clear where step > 0")
def clear_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clears of all users as compare-and-set with base versions and re-sent attempts."""
    return _clears(spark, sf_dir).drop("mutation_id")


@query(
    _CLEARS.replace("with recursive clear", _FOLD.replace(" turn t", " dense_turn t").replace("from mutation)", "from dense_turn)") + ", clear")
    + """ select user_id, cast(row_number() over (partition by user_id order by arrival, entity_kind, entity_id) as bigint) as seq, entity_kind, entity_id, version, arrival from (
      select entity_id % 250 as user_id, 'filter' as entity_kind, cast(entity_id as varchar) as entity_id, version, arrival from fold where outcome = 'applied'
      union all select user_id, 'feed-state', 'feed', version, arrival from clear where outcome = 'applied' and stepped)"""
)
def write_state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all users from outcomes in two deliveries, the second of which brings
    all of the first again."""
    filters = fold.apply_mutations(_dense_log(spark, sf_dir)).withColumn("user_id", F.col("entity_id") % 250)
    changes = materialise(clears.state_changes(filters, _clears(spark, sf_dir)), "changes")
    half = changes.agg(F.max("arrival")).first()[0] // 2
    empty = spark.createDataFrame([], "user_id long, seq long, entity_kind string, entity_id string, version long, arrival long")
    first = materialise(clears.write_state_log(empty, changes.filter(F.col("arrival") <= half)), "log")
    return first.unionByName(clears.write_state_log(first, changes))


@query("select user_id, max(seq) as head_seq, count(*) as n from state_log group by user_id")
def state_log_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.log_heads(state_log(spark, sf_dir))


@query("select user_id, entity_id, max(seq) as changed_revision from state_log group by user_id, entity_id")
def changed_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changed_revisions(state_log(spark, sf_dir))


T.VIEW_SQL["pull_request"] = """
 select concat('user', u) as user_id, cast(u * 30 as bigint) as after_seq, case when u % 6 = 1 then null when u % 6 = 2 then 'e0' else 'e1' end as epoch
 from (select distinct user_id as u from events)"""


@query(
    """select q.user_id, case when q.epoch is distinct from 'e1' or q.after_seq < 900 then 'snapshot' else 'delta' end as mode,
     e.entity_id, e.n as version
    from pull_request q join (select user_id, entity_id, count(*) as n, max(seq) as last_seq from state_log group by user_id, entity_id) e on e.user_id = q.user_id
    where q.epoch is distinct from 'e1' or q.after_seq < 900 or e.last_seq > q.after_seq"""
)
def pull_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta or full snapshot for the pull request of every user."""
    log, u = state_log(spark, sf_dir), F.col("user_id")
    users = T.read(spark, sf_dir, "events").select("user_id").distinct()
    requests = users.select(
        F.concat(F.lit("user"), u).alias("user_id"),
        (u * 30).cast("long").alias("after_seq"),
        F.when(u % 6 == 2, "e0").when(u % 6 != 1, "e1").alias("epoch"),
    )
    states = state.log_heads(log).select(
        "user_id", F.lit(900).alias("floor_seq"), "head_seq", F.lit("e1").alias("epoch")
    )
    entities = log.groupBy("user_id", "entity_id").agg(F.count("*").alias("version"))
    return state.pull_state(requests, log, states, entities)


# Pending operations: one user's replica row per (login, type), operations from later events.
T.VIEW_SQL["replica"] = """
 select concat(actor_login, ':', type) as id, max(title || seq % 10) as value, max(seq) % 7 = 0 as deleted
 from activity group by 1"""
T.VIEW_SQL["pending"] = """
 select concat(actor_login, ':', case when type = 'view' then 'note' else type end) as id, concat('edit ', seq) as value, case when seq % 5 = 0 then 'delete' else 'put' end as kind,
  seq as local_sequence, seq % 11 = 0 as conflict_copy from activity"""


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.activity(spark, sf_dir)
    return (
        rows.groupBy(F.concat("actor_login", F.lit(":"), "type").alias("id"))
        .agg(F.max(F.concat("title", F.col("seq") % 10)).alias("value"), F.max("seq").alias("_s"))
        .select("id", "value", (F.col("_s") % 7 == 0).alias("deleted"))
    )


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    part = F.when(F.col("type") == "view", "note").otherwise(F.col("type"))
    return T.activity(spark, sf_dir).select(
        F.concat("actor_login", F.lit(":"), part).alias("id"),
        F.concat(F.lit("edit "), seq).alias("value"),
        F.when(seq % 5 == 0, "delete").otherwise("put").alias("kind"),
        seq.alias("local_sequence"),
        (seq % 11 == 0).alias("conflict_copy"),
    )


_LAST = "select * from (select *, row_number() over (partition by id order by local_sequence desc) as n from pending) where n = 1"


@query(
    f"""select coalesce(r.id, p.id) as id, coalesce(p.value, r.value) as value,
     case when p.id is null then 'synced' when p.conflict_copy then 'conflict-copy' else 'pending' end as sync
    from (select * from replica where not deleted) r full join ({_LAST}) p on p.id = r.id where coalesce(p.kind, 'put') = 'put'"""
)
def overlay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.overlay(_replicas(spark, sf_dir), _pending(spark, sf_dir))


@query(
    """select coalesce(s.viewer_id, p.user_id) as user_id, greatest(s.cleared_ms, p.best) as cleared_ms, p.last_seq - 1 as provisional_through
    from feed_state s full join (select cast((seq - 1) % 25 as integer) as user_id, max(published_ms) as best, max(seq) as last_seq
     from activity group by 1) p on p.user_id = s.viewer_id"""
)
def overlay_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    clears = T.activity(spark, sf_dir).select(
        ((F.col("seq") - 1) % 25).cast("int").alias("user_id"),
        F.col("published_ms").alias("candidate_ms"),
        F.col("seq").alias("local_sequence"),
    )
    server = T.feed_state(spark, sf_dir).select(F.col("viewer_id").alias("user_id"), "cleared_ms")
    return state.overlay_clear(server, clears)


# Three versions of a keyed table: rows change, vanish or appear on either side.
_SIDE_SQL = """select event_id as id, case when event_id % {a} = 1 then '{n}' else 'base' end as name,
 case when event_id % {b} = 2 then concat('{n}', event_id % 2) else null end as rule from events where event_id % {c} <> 0"""
T.VIEW_SQL["base_side"] = "select event_id as id, 'base' as name, cast(null as varchar) as rule from events where event_id % 10 <> 9"
T.VIEW_SQL["local_side"] = _SIDE_SQL.format(a=3, b=5, c=11, n="local")
T.VIEW_SQL["remote_side"] = _SIDE_SQL.format(a=4, b=7, c=13, n="remote")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events, n = T.read(spark, sf_dir, "events"), F.col("event_id")

    def side(a: int, b: int, c: int, name: str) -> DataFrame:
        return events.filter(n % c != 0).select(
            n.alias("id"),
            F.when(n % a == 1, name).otherwise("base").alias("name"),
            F.when(n % b == 2, F.concat(F.lit(name), n % 2)).alias("rule"),
        )

    base = events.filter(n % 10 != 9).select(
        n.alias("id"), F.lit("base").alias("name"), F.lit(None).cast("string").alias("rule")
    )
    return base, side(3, 5, 11, "local"), side(4, 7, 13, "remote")


_SAME = "((({0}.id is null) = ({1}.id is null)) and {0}.name is not distinct from {1}.name and {0}.rule is not distinct from {1}.rule)"
_LB, _RB, _LR = _SAME.format("l", "b"), _SAME.format("r", "b"), _SAME.format("l", "r")
_FIELD_OK = "(l.{0} is not distinct from b.{0} or r.{0} is not distinct from b.{0} or l.{0} is not distinct from r.{0})"
_ALL_OK = f"(b.id is not null and l.id is not null and r.id is not null and {_FIELD_OK.format('name')} and {_FIELD_OK.format('rule')})"
_PICK = "case when {lb} then r.{f} when {rb} or {lr} then l.{f} when {ok} then case when l.{f} is not distinct from b.{f} then r.{f} else l.{f} end end as {f}"
_MERGED = f"""select coalesce(b.id, l.id, r.id) as id,
 case when {_LB} then case when r.id is null then 'deleted' else 'merged' end
  when {_RB} or {_LR} then case when l.id is null then 'deleted' else 'merged' end
  when {_ALL_OK} then 'merged' else 'conflict' end as status,
 {_PICK.format(lb=_LB, rb=_RB, lr=_LR, ok=_ALL_OK, f="name")}, {_PICK.format(lb=_LB, rb=_RB, lr=_LR, ok=_ALL_OK, f="rule")}
 from base_side b full join local_side l on l.id = b.id full join remote_side r on r.id = coalesce(b.id, l.id)"""


@query(_MERGED)
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.three_way_merge(*_sides(spark, sf_dir), "id", ["name", "rule"])


@query(
    f"""select id // 4 as parent, case when bool_or(status = 'conflict') then 'conflict' else 'merged' end as status,
     count(*) filter (status = 'merged') as n_items from ({_MERGED}) group by id // 4"""
)
def merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists merged by item id: one conflicting item spoils its list."""
    merged = state.three_way_merge(*_sides(spark, sf_dir), "id", ["name", "rule"])
    return state.merge_lists(merged, F.floor(F.col("id") / 4))


@query(
    """select concat('r', event_id) as parent, case when event_id % 3 <> 0 and event_id % 2 <> 0 then 'conflict' else 'merged' end as status,
     cast(case when event_id % 3 <> 0 and event_id % 2 <> 0 then 0 else 1 end + case when event_id % 5 <> 0 then 1 else 0 end
      + case when event_id % 4 = 1 then 1 else 0 end as bigint) as n_items from events"""
)
def merge_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on three versions of every rule, top-level condition by condition."""
    events, n = T.read(spark, sf_dir, "events"), F.col("event_id")

    def side(*conditions) -> DataFrame:
        made = F.concat(F.lit('{"conditions":['), F.concat_ws(",", *conditions), F.lit("]}"))
        return events.select(F.concat(F.lit("r"), n).alias("rule_id"), made.alias("rule_text"))

    def condition(name: str, value) -> Column:
        return F.concat(F.lit(f'{{"id":"{name}","args":['), value.cast("string"), F.lit("]}"))

    zero = F.lit(0)
    return state.merge_conditions(
        side(condition("c1", zero), condition("c2", zero)),
        side(
            condition("c1", n % 3), condition("c2", zero), F.when(n % 4 == 1, condition("c3", zero))
        ),
        side(condition("c1", n % 2 * 5), F.when(n % 5 != 0, condition("c2", zero))),
    )


# Three versions of a rule for every turn, whose texts hold what was said. The edits
# are told by the length of the text and the turn; LOCAL and REMOTE write keys apart.
T.VIEW_SQL["edited"] = """
 select concat(conv_id, '-', turn) as rule_id, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g') as word, coalesce(role, '') as role,
  n % 3 = 0 as l1, n % 4 = 1 as l2, turn % 5 = 2 as l3, n % 2 = 0 as l4, turn % 11 = 7 as gone,
  n % 6 = 0 as r1, n % 5 = 0 as r2, turn % 7 = 3 as r3, n % 7 = 0 as r4
 from (select *, length(coalesce(text, '')) as n from conversations)"""


def _rule_versions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Base, local and remote: (rule_id, rule_text)."""
    turn, n = F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    said = T.read(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("rule_id"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "").alias("word"),
        F.coalesce("role", F.lit("")).alias("role"),
        *((n % k == v).alias(c) for c, k, v in [("l1", 3, 0), ("l2", 4, 1), ("l4", 2, 0), ("r1", 6, 0), ("r2", 5, 0), ("r4", 7, 0)]),
        *((turn % k == v).alias(c) for c, k, v in [("l3", 5, 2), ("gone", 11, 7), ("r3", 7, 3)]),
    )

    def text(mark, name, inner, extra, second, third, head="") -> Column:
        first = F.concat(F.lit('{"id": "c1", "type": "Filter", "path": ["title"], "name": "contains", "args": ["'), "word", mark, F.lit('"]}'))
        other = F.concat(F.lit('{"type": "Filter", "id": "c2", "path": ["type"], "name": "'), name, F.lit('", "args": ["'), "role", F.lit('"]}'))
        nested = F.concat(
            F.lit('{"type": "FilterGroup", "id": "g", "op": "'), inner, F.lit('", "conditions": ['), extra, F.lit("]}")
        )
        items = F.concat_ws(", ", first, F.when(second, other), F.when(third, nested))
        return F.concat(F.lit("{" + head + '"type": "FilterGroup", "id": "root", "conditions": ['), items, F.lit(']' + ("" if head else ', "op": "and"') + "}"))

    def inner(invert: Column, more: Column) -> Column:
        n1 = F.concat(F.lit('{"id": "n1", "type": "Filter", "path": ["repo"], "name": "startsWith", "args": ["a"]'), F.when(invert, F.lit(', "invert": true')).otherwise(F.lit("")), F.lit("}"))
        n2 = F.lit('{"id": "n2", "type": "Filter", "path": ["repo"], "name": "endsWith", "args": ["b"]}')
        x = F.lit('{"args": [], "id": "x", "type": "Filter", "path": ["summary"], "name": "isEmpty"}')
        return F.concat_ws(",", n1, n2, F.when(more, x))

    no, yes, empty, op = F.lit(False), F.lit(True), F.lit(""), F.lit("or")
    equals, c = F.lit("equals"), F.col
    base = text(empty, equals, op, inner(no, no), yes, yes)
    local = text(F.when(c("l1"), " x").otherwise(""), equals, F.when(c("l2"), "and").otherwise("or"), inner(no, c("l4")), ~c("l3"), yes, '"op": "and", ')
    remote = text(F.when(c("r1"), " y").otherwise(""), F.when(c("r4"), "notEqual").otherwise("equals"), op, inner(c("r2"), no), yes, ~c("r3"))
    return [
        said.select("rule_id", base.alias("rule_text")),
        said.filter(~c("gone")).select("rule_id", local.alias("rule_text")),
        said.select("rule_id", remote.alias("rule_text")),
    ]


@query(
    """select rule_id, case when n_conflicts > 0 then 'conflict' when gone then 'deleted' else 'merged' end as status, cast(n_conflicts as bigint) as n_conflicts,
     case when n_conflicts = 0 and not gone then concat('{"conditions":[{"args":["', word, case when l1 then ' x' when r1 then ' y' else '' end,
      '"],"id":"c1","name":"contains","path":["title"],"type":"Filter"}',
      case when l3 then '' else concat(',{"args":["', role, '"],"id":"c2","name":"', case when r4 then 'notEqual' else 'equals' end, '","path":["type"],"type":"Filter"}') end,
      case when r3 then '' else concat(',{"conditions":[{"args":["a"],"id":"n1",', case when r2 then '"invert":true,' else '' end, '"name":"startsWith","path":["repo"],"type":"Filter"}',
       ',{"args":["b"],"id":"n2","name":"endsWith","path":["repo"],"type":"Filter"}',
       case when l4 then ',{"args":[],"id":"x","name":"isEmpty","path":["summary"],"type":"Filter"}' else '' end,
       '],"id":"g","op":"', case when l2 then 'and' else 'or' end, '","type":"FilterGroup"}') end,
      '],"id":"root","op":"and","type":"FilterGroup"}') end as rule_text
    from (select *, case when gone then case when r1 or r2 or r3 or r4 then 1 else 0 end
      else cast(l1 and r1 as integer) + cast(l3 and r4 as integer) + cast(r3 and (l2 or l4) as integer) end as n_conflicts from edited)"""
)
def merge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a rule for every turn of a conversation, merged node by node."""
    merged = merge.merge_rules(*_rule_versions(spark, sf_dir))
    return merged.select("rule_id", "status", F.size("conflicts").cast("long").alias("n_conflicts"), "rule_text")


T.VIEW_SQL["outbox"] = "select user_id as entity_id, event_id as local_sequence, concat('t', event_id) as attempt_id, event_id % 9 as base_version from events"
T.VIEW_SQL["conflict_at"] = "select user_id as entity_id, max(event_id) as at_sequence from events where event_id % 4 = 0 and user_id % 3 = 0 group by user_id"


@query(
    """select case when o.local_sequence >= c.at_sequence then sha256(concat('copy:', o.entity_id, ':', c.at_sequence)) else cast(o.entity_id as varchar) end as entity_id,
     o.local_sequence, case when o.local_sequence >= c.at_sequence then sha256(concat('attempt:', o.attempt_id, ':', o.local_sequence)) else o.attempt_id end as attempt_id,
     case when o.local_sequence = c.at_sequence then 0 else o.base_version end as base_version, coalesce(o.local_sequence >= c.at_sequence, false) as conflict_copy
    from outbox o left join conflict_at c on c.entity_id = o.entity_id"""
)
def split_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, n = T.read(spark, sf_dir, "events"), F.col("event_id")
    outbox = events.select(
        F.col("user_id").alias("entity_id"),
        n.alias("local_sequence"),
        F.concat(F.lit("t"), n).alias("attempt_id"),
        (n % 9).alias("base_version"),
    )
    hit = events.filter((n % 4 == 0) & (F.col("user_id") % 3 == 0))
    conflicts = hit.groupBy(F.col("user_id").alias("entity_id")).agg(F.max(n).alias("at_sequence"))
    return state.split_conflicts(outbox, conflicts)


_N_RULES = len(SAMPLE_RULES)
_INVALID = ", ".join(str(i) for i, (_, sql) in enumerate(SAMPLE_RULES) if sql is None)


@query(
    f"""select event_id as local_sequence, case when event_id % {_N_RULES} in ({_INVALID}) and event_id % 4 <> 3 then 'blocked' else 'pending' end as status,
     event_id % 10 = 0 or (event_id % {_N_RULES} in ({_INVALID}) and event_id % 4 <> 3) as conflict_copy from events"""
)
def blocked_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending operations whose rule does not validate."""
    texts, n = F.array(*[F.lit(text) for text, _ in SAMPLE_RULES]), F.col("event_id")
    outbox = T.read(spark, sf_dir, "events").select(
        n.alias("local_sequence"),
        F.when(n % 4 == 3, "delete").otherwise("put").alias("kind"),
        F.element_at(texts, (n % _N_RULES + 1).cast("int")).alias("rule_text"),
        (n % 10 == 0).alias("conflict_copy"),
    )
    return state.mark_blocked(outbox).select("local_sequence", "status", "conflict_copy")


@query(
    """select p.mutation_id, case when r.outcome = 'conflict' then sha256(concat('retry:', p.mutation_id, ':', p.attempt_id)) else p.attempt_id end as attempt_id
    from mutation p left join (select mutation_id, case when arrival % 3 = 0 then 'applied' when arrival % 3 = 1 then 'conflict' else 'already-applied' end as outcome
     from mutation where entity_id % 4 <> 1) r on r.mutation_id = p.mutation_id
    where r.outcome is null or r.outcome = 'conflict'"""
)
def acknowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending, turn = T.mutations(spark, sf_dir), F.col("arrival") % 3
    verdict = F.when(turn == 0, "applied").when(turn == 1, "conflict").otherwise("already-applied")
    results = pending.filter(F.col("entity_id") % 4 != 1).select(
        "mutation_id", verdict.alias("outcome")
    )
    return state.acknowledge(pending, results).select("mutation_id", "attempt_id")


@query(
    """select coalesce(o.viewer_id, n.viewer_id) as viewer_id, coalesce(o.actor_key, n.actor_key) as actor_key,
     case when o.login is null then 'insert' when n.login is null then 'delete' else 'update' end as change,
     coalesce(o.version, 0) + 1 as version, n.login is null as deleted
    from (select viewer_id, actor_key, login, cast(length(login) as bigint) as version from member where revision = 'r1') o
    full join (select viewer_id, actor_key, case when length(login) = 6 then concat(login, '2') else login end as login from member where revision = 'r2') n
     on n.viewer_id = o.viewer_id and n.actor_key = o.actor_key
    where o.login is distinct from n.login"""
)
def changes_from_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, login = T.members(spark, sf_dir), F.col("login")
    before = rows.filter(F.col("revision") == T.PREVIOUS).withColumn("version", F.length("login").cast("long"))
    after = rows.filter(F.col("revision") == T.ACTIVE).withColumn(
        "login", F.when(F.length("login") == 6, F.concat(login, F.lit("2"))).otherwise(login)
    )
    return state.derive_changes(before, after, ["viewer_id", "actor_key"], ["login"])


# Projections -------------------------------------------------------------------


def _facts(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return projection.facts(
        T.activity(spark, sf_dir) if rows is None else rows,
        membership(spark, sf_dir),
        T.VIEWER,
        R.rules_of(user_filter(spark, sf_dir), T.VIEWER),
    )


T.VIEW_SQL["fact"] = """
 select a.activity_id, a.actor_key, m.actor_key as member_key, a.type, a.published_ms, a.seq,
  case when m.key is not null and not a.hidden and not exists (
   select 1 from rule_hit h join user_filter f on f.rule_ix = h.rule_ix where f.viewer_id = 3 and not f.deleted and h.activity_id = a.activity_id) then 1 else 0 end as visible
 from activity a left join membership m on m.key = a.actor_key and m.viewer_id = 3 and m.revision = 'r2'"""


@query("select activity_id, actor_key, member_key, type, published_ms, visible from fact")
def projection_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).drop("seq")


_AGGREGATES = """
 select 'actor_type' as level, actor_key, type, null as member_key, count(*) as n, max(published_ms) as latest_ms from fact where visible = 1 group by actor_key, type
 union all select 'type', null, type, null, count(*), max(published_ms) from fact where visible = 1 group by type
 union all select 'member', null, null, member_key, count(*), max(published_ms) from fact where visible = 1 group by member_key"""


@query(_AGGREGATES)
def projection_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three aggregates of one viewer's visible facts in one pass."""
    return projection.aggregates(_facts(spark, sf_dir))


@query(_AGGREGATES)
def incremental_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revision ranges aggregated apart and merged; equals the full rebuild."""
    rows = T.activity(spark, sf_dir)
    half = ingest.head_seq(rows) // 2
    parts = [
        projection.aggregates(_facts(spark, sf_dir, rows.filter(cond)))
        for cond in (F.col("seq") <= half, F.col("seq") > half)
    ]
    return projection.merge_aggregates(*parts)


@query("select type, count(*) as n from fact where visible = 1 group by type")
def projection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type from the aggregate; must equal counting the facts."""
    cells = projection.aggregates(_facts(spark, sf_dir)).filter(F.col("level") == "actor_type")
    return projection.statistics(cells)


@query(
    """select m.actor_key, m.login, coalesce(s.n, 0) as n, coalesce(s.latest_ms, 0) as latest_ms from member m
    left join (select member_key, count(*) as n, max(published_ms) as latest_ms from fact where visible = 1 group by member_key) s on s.member_key = m.actor_key
    where m.viewer_id = 3 and m.revision = 'r2'"""
)
def refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New member list on kept counts."""
    cells = projection.aggregates(_facts(spark, sf_dir)).filter(F.col("level") == "member")
    rows = T.members(spark, sf_dir).filter(
        (F.col("revision") == T.ACTIVE) & (F.col("viewer_id") == T.VIEWER)
    )
    return projection.refresh_summary(rows, cells)
