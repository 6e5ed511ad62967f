"""Aliases, follow lists, selections and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import identity, replication
from rookery.operators.ranking import numbered_within
from rookery.plans.catalog import query
from rookery.sources import tables as T


def _revision(spark: SparkSession, sf_dir: str, revision: str) -> DataFrame:
    return T.members(spark, sf_dir).filter(F.col("revision") == revision)


@query("select viewer_id, revision, key, actor_key from membership")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.membership(T.members(spark, sf_dir))


@query("select distinct viewer_id, revision, key from membership")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.expand_keys(T.members(spark, sf_dir))


_SIDES = "(select viewer_id, login from member where revision = 'r1') o full join (select viewer_id, login from member where revision = 'r2') n on n.viewer_id = o.viewer_id and n.login = o.login"
_DIFF = f"""select coalesce(o.viewer_id, n.viewer_id) as viewer_id, coalesce(o.login, n.login) as login,
 case when o.login is null then 'added' when n.login is null then 'removed' else 'kept' end as status from {_SIDES}"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.following_diff(
        _revision(spark, sf_dir, T.PREVIOUS), _revision(spark, sf_dir, T.ACTIVE)
    )


@query(_DIFF)
def following_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(
    f"""select viewer_id, count(*) filter (status <> 'removed') as total, count(*) filter (status = 'added') as added,
     count(*) filter (status = 'removed') as removed from ({_DIFF}) group by viewer_id"""
)
def following_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.diff_counts(_diff(spark, sf_dir))


@query(
    """select distinct viewer_id, key from membership n where revision = 'r2' and not exists (
     select 1 from membership o where o.revision = 'r1' and o.viewer_id = n.viewer_id and o.key = n.key)"""
)
def additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.additions(T.members(spark, sf_dir), T.ACTIVE, T.PREVIOUS)


# Every viewer asks for the actors of some activity, by key, alias or unknown key.
T.VIEW_SQL["asked_key"] = """
 select distinct cast((seq - 1) % 24 as integer) as viewer_id,
  case when seq % 3 = 0 then concat('legacy-atom-login:', actor_login) when seq % 17 = 0 then concat(actor_key, '-gone') else actor_key end as key
 from activity"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, key = F.col("seq"), F.col("actor_key")
    asked = (
        F.when(seq % 3 == 0, F.concat(F.lit("legacy-atom-login:"), "actor_login"))
        .when(seq % 17 == 0, F.concat(key, F.lit("-gone")))
        .otherwise(key)
    )
    rows = T.activity(spark, sf_dir)
    return rows.select(((seq - 1) % 24).cast("int").alias("viewer_id"), asked.alias("key"))


@query(
    """select distinct m.viewer_id, m.key, 'authorised' as status from membership m
     where m.revision = 'r2' and exists (select 1 from membership j join asked_key a on a.viewer_id = j.viewer_id and a.key = j.key
      where j.revision = 'r2' and j.viewer_id = m.viewer_id and j.actor_key = m.actor_key)
    union all select viewer_id, key, 'rejected' from asked_key a where not exists (
     select 1 from membership j where j.revision = 'r2' and j.viewer_id = a.viewer_id and j.key = a.key)"""
)
def selection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.check_selection(_asked(spark, sf_dir), _revision(spark, sf_dir, T.ACTIVE))


T.VIEW_SQL["asked_value"] = """
 select cast((seq - 1) % 24 as integer) as viewer_id, seq as pos,
  case seq % 3 when 0 then actor_key when 1 then concat(' ', upper(actor_login)) else concat('gone', seq % 5) end as value
 from activity"""
_RESOLVED = """select v.viewer_id, v.pos, v.value, coalesce(k.actor_key, l.actor_key) as key from asked_value v
 left join (select viewer_id, actor_key from member where revision = 'r2') k on k.viewer_id = v.viewer_id and k.actor_key = v.value
 left join (select viewer_id, actor_key, lower(login) as login from member where revision = 'r2') l
  on l.viewer_id = v.viewer_id and l.login = lower(trim(v.value))"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    value = (
        F.when(seq % 3 == 0, F.col("actor_key"))
        .when(seq % 3 == 1, F.concat(F.lit(" "), F.upper("actor_login")))
        .otherwise(F.concat(F.lit("gone"), seq % 5))
    )
    rows = T.activity(spark, sf_dir)
    return rows.select(
        ((seq - 1) % 24).cast("int").alias("viewer_id"), value.alias("value"), seq.alias("pos")
    )


@query(
    f"select viewer_id, key, min(pos) as first_pos from ({_RESOLVED}) where key is not null group by viewer_id, key"
)
def canonicalise_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonicalise_selection(
        _values(spark, sf_dir), _revision(spark, sf_dir, T.ACTIVE), complete=True
    )


@query(
    f"select viewer_id, coalesce(key, value) as key, min(pos) as first_pos from ({_RESOLVED}) group by viewer_id, coalesce(key, value)"
)
def canonicalise_partial_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonicalise_selection(
        _values(spark, sf_dir), _revision(spark, sf_dir, T.ACTIVE), complete=False
    )


@query(
    """select seq, case when (seq - 1) % 4 = 0 then 'invalid-selection'
     when (seq - 1) % 4 = 1 then case when type < 'invalid-selection' then concat(type, ',', 'invalid-selection') else concat('invalid-selection', ',', type) end
     else case when type < actor_key then concat(type, ',', actor_key) else concat(actor_key, ',', type) end end as selection
    from activity"""
)
def canonical_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq") - 1
    parts = (
        F.when(n % 4 == 0, F.array().cast("array<string>"))
        .when(n % 4 == 1, F.array(F.col("type"), F.lit(""), F.repeat(F.lit("x"), 257)))
        .otherwise(F.array("type", "actor_key", "type"))
    )
    chosen = identity.canonical_selection(parts, identity.MAX_ACTORS)
    return T.activity(spark, sf_dir).select("seq", F.array_join(chosen, ",").alias("selection"))


T.VIEW_SQL["seen_login"] = """
 select login, id from github_user where id is not null
 union all select concat('Old', user_id, '-', event_type), cast(user_id as varchar) from events where user_id % 10 <> 0"""


@query("select distinct id, concat('legacy-atom-login:', lower(login)) as alias_key from seen_login")
def alias_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logins ever seen with a numeric id, over account rows and old names."""
    user = F.col("user_id")
    old = T.read(spark, sf_dir, "events").filter(user % 10 != 0)
    seen = T.github_user(spark, sf_dir).select("login", "id").unionByName(
        old.select(
            F.concat(F.lit("Old"), user, F.lit("-"), "event_type").alias("login"),
            user.cast("string").alias("id"),
        )
    )
    return identity.discover_aliases(seen)


def _xor_sql(line: str) -> str:
    parts = ", ".join(
        f"printf('%08x', bit_xor(cast('0x' || substr(sha256({line}), {8 * i + 1}, 8) as bigint)))" for i in range(8)
    )
    return f"concat(count(*), ':', {parts})"


# JSON writes the NUL between key and canonical key as an escape of six characters.
_PAIR = r"""concat('"', key, '\u0000', actor_key, '"')"""


@query(
    f"""select viewer_id, revision, {_xor_sql("line")} as signature from (
     select viewer_id, revision, actor_key, concat('[', string_agg({_PAIR}, ',' order by key), ']') as line
     from membership group by viewer_id, revision, actor_key)
    group by viewer_id, revision"""
)
def membership_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.membership_signature(T.members(spark, sf_dir), ["viewer_id", "revision"])


_LINE = "concat(s.key, ':', coalesce(r.retention_generation, 0))"


@query(
    f"""select s.viewer_id, s.revision, {_xor_sql(_LINE)} as fingerprint
    from (select distinct viewer_id, revision, key from membership) s left join retention r on r.actor_key = s.key
    group by s.viewer_id, s.revision"""
)
def retention_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.retention_fingerprint(
        identity.scope_keys(T.members(spark, sf_dir)),
        T.retention(spark, sf_dir),
        ["viewer_id", "revision"],
    )


@query(
    f"""select v.viewer_id, v.from_seq, max(case when r.compacted_through_seq > v.from_seq then r.compacted_through_seq end) as gap_through_seq
    from (select n_nationkey as viewer_id, cast(n_nationkey % 7 as bigint) * 40 as from_seq from nation) v
    left join membership s on s.viewer_id = v.viewer_id and s.revision = 'r2' left join retention r on r.actor_key = s.key
    group by v.viewer_id, v.from_seq"""
)
def gap_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.gap_floor(
        positions(spark, sf_dir),
        identity.scope_keys(_revision(spark, sf_dir, T.ACTIVE)).drop("revision"),
        T.retention(spark, sf_dir),
    )


def positions(spark: SparkSession, sf_dir: str, step: int = 40) -> DataFrame:
    """Where every viewer's replica stands."""
    v = F.col("n_nationkey")
    return T.read(spark, sf_dir, "nation").select(
        v.alias("viewer_id"), ((v % 7) * step).cast("long").alias("from_seq")
    )


T.VIEW_SQL["asked_scope"] = """
 select viewer_id, concat('legacy-atom-login:', login) as key from member where revision = 'r2' and length(login) = 5
 union all select distinct viewer_id, 'github:none' from member where viewer_id % 5 = 2 and revision = 'r2' and length(login) = 5"""


@query(
    """select a.viewer_id, sha256(concat('{"protocol":1,"actorKeys":[', string_agg(concat('"', a.key, '"'), ',' order by a.key), ']}')) as scope_key,
     bool_and(m.key is not null) as authorised,
     case when bool_and(m.key is not null) then (select count(distinct g.key) from membership g
      where g.revision = 'r2' and g.viewer_id = a.viewer_id and exists (select 1 from asked_scope s join membership j on j.viewer_id = s.viewer_id and j.key = s.key and j.revision = 'r2'
       where s.viewer_id = g.viewer_id and j.actor_key = g.actor_key)) else 0 end as n_keys
    from asked_scope a left join membership m on m.viewer_id = a.viewer_id and m.key = a.key and m.revision = 'r2'
    group by a.viewer_id"""
)
def resolve_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actor-list scopes: hash of the request, verdict and size of the alias groups."""
    v = F.col("viewer_id")
    keys = (
        _revision(spark, sf_dir, T.ACTIVE)
        .filter(F.length("login") == 5)
        .groupBy("viewer_id")
        .agg(F.collect_set(F.concat(F.lit("legacy-atom-login:"), "login")).alias("keys"))
    )
    odd = F.when(v % 5 == 2, F.array(F.lit("github:none"))).otherwise(F.array().cast("array<string>"))
    requests = keys.select("viewer_id", F.concat("keys", odd).alias("keys"))
    return identity.resolve_scope(requests, _revision(spark, sf_dir, T.ACTIVE))


# Snapshots ---------------------------------------------------------------------


@query(
    """select viewer_id, revision, actor_key, login, row_number() over (partition by viewer_id, revision order by actor_key) - 1 as position from member"""
)
def assign_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positioned(spark, sf_dir).select("viewer_id", "revision", "actor_key", "login", "position")


def _positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.members(spark, sf_dir)
    return numbered_within(rows, ["viewer_id", "revision"], [F.col("actor_key")], "position")


@query(
    """select actor_key, login, position from (
     select *, row_number() over (order by actor_key) - 1 as position from member where viewer_id = 3 and revision = 'r2')
    where position > 9 order by position limit 21"""
)
def snapshot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _revision(spark, sf_dir, T.ACTIVE).filter(F.col("viewer_id") == T.VIEWER)
    placed = numbered_within(rows, ["viewer_id", "revision"], [F.col("actor_key")], "position")
    return replication.snapshot_page(placed, 9, 20).select("actor_key", "login", "position")


T.VIEW_SQL["snapshot"] = """
 select n_nationkey as viewer_id, r.revision, r.completed_ms from nation
 cross join (values ('r0', 1), ('r1', 2), ('r2', 3)) r(revision, completed_ms) where n_nationkey <> 23 or r.revision <> 'r2'"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three revisions per viewer; viewer 24 has no members, viewer 23 lacks the last."""
    revisions = F.array(*[F.struct(F.lit(r).alias("revision"), F.lit(i).alias("completed_ms"))
                          for i, r in enumerate(("r0", "r1", "r2"), 1)])
    return (
        T.read(spark, sf_dir, "nation")
        .select(F.col("n_nationkey").alias("viewer_id"), F.explode(revisions).alias("r"))
        .select("viewer_id", "r.revision", "r.completed_ms")
        .filter((F.col("viewer_id") != 23) | (F.col("revision") != "r2"))
    )


@query(
    """select s.viewer_id, s.revision, m.actor_key, m.login from snapshot s
    left join member m on m.viewer_id = s.viewer_id and m.revision = s.revision"""
)
def snapshot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.members(spark, sf_dir).select("viewer_id", "revision", "actor_key", "login")
    out = replication.snapshot_members(snapshots(spark, sf_dir), rows)
    return out.select("viewer_id", "revision", "actor_key", "login")


@query(
    """select s.viewer_id, s.revision as active_revision, m.actor_key from (
     select *, row_number() over (partition by viewer_id order by completed_ms desc, revision desc) as n from snapshot) s
    left join member m on m.viewer_id = s.viewer_id and m.revision = s.revision where s.n = 1"""
)
def active_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State -> active snapshot -> members, for all viewers."""
    from rookery.operators.ranking import last_by

    active = last_by(snapshots(spark, sf_dir), ["viewer_id"], ["completed_ms", "revision"])
    rows = T.members(spark, sf_dir).select("viewer_id", "revision", "actor_key")
    return replication.snapshot_members(active, rows).select(
        "viewer_id", F.col("revision").alias("active_revision"), "actor_key"
    )


@query(
    """select m.viewer_id, m.revision, count(*) as n from (
      select viewer_id, revision, actor_key from member union all select viewer_id, 'r0', actor_key from member where revision = 'r1') m
     join (select *, row_number() over (partition by viewer_id order by completed_ms desc, revision desc) as n from snapshot) s
     on s.viewer_id = m.viewer_id and s.revision = m.revision and s.n <= 2 group by m.viewer_id, m.revision"""
)
def prune_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.members(spark, sf_dir).select("viewer_id", "revision", "actor_key")
    older = rows.filter(F.col("revision") == T.PREVIOUS).withColumn("revision", F.lit("r0"))
    kept = replication.prune_revisions(snapshots(spark, sf_dir), rows.unionByName(older))
    return kept.groupBy("viewer_id", "revision").agg(F.count("*").alias("n"))


@query(
    """select n.viewer_id, n.login, case when o.login is null then 1706659200000 else 1000 + o.viewer_id end as created_ms
    from (select * from member where revision = 'r2') n
    left join (select * from member where revision = 'r1') o on o.viewer_id = n.viewer_id and o.login = n.login"""
)
def replace_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _revision(spark, sf_dir, T.PREVIOUS).select(
        "viewer_id", "login", (F.lit(1000) + F.col("viewer_id")).cast("long").alias("created_ms")
    )
    remote = _revision(spark, sf_dir, T.ACTIVE).select("viewer_id", "login")
    return replication.replace_snapshot(current, remote, T.NOW_MS)


@query(
    """select revision, count(distinct viewer_id) as n_viewers, count(*) as n_members from member group by revision"""
)
def distinct_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.members(spark, sf_dir)
    return rows.groupBy("revision").agg(
        F.count_distinct("viewer_id").alias("n_viewers"), F.count("*").alias("n_members")
    )
