"""Feed, following, statistics and paging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import text as X
from rookery.functions import values as V
from rookery.operators import feed, identity, ranking
from rookery.operators import rules as R
from rookery.plans.catalog import query
from rookery.plans.rule_queries import membership, user_filter
from rookery.sources import tables as T

# The one-viewer feed as SQL: rules 5 and 7 are the live rules of viewer 3.
T.VIEW_SQL["viewer_feed"] = """
 select a.* from activity a join github_user u on u.login = a.actor_login
 join subscription s on s.login = a.actor_login and s.viewer_id = 3
 where not a.hidden and a.published_ms > (select cleared_ms from feed_state where viewer_id = 3)
 and not exists (select 1 from rule_hit h join user_filter f on f.rule_ix = h.rule_ix
  where f.viewer_id = 3 and not f.deleted and h.activity_id = a.activity_id)"""


def viewer_feed(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Everything the sample viewer may see, with that viewer's rules and watermark."""
    state = T.feed_state(spark, sf_dir).filter(F.col("viewer_id") == T.VIEWER).first()
    return feed.visible_feed(
        T.activity(spark, sf_dir) if rows is None else rows,
        T.github_user(spark, sf_dir),
        T.subscriptions(spark, sf_dir),
        T.VIEWER,
        R.rules_of(user_filter(spark, sf_dir), T.VIEWER),
        state["cleared_ms"] if state else None,
    )


_PAGE = "activity_id, actor_login, title, repo, type, summary, published_ms"
_PAGE_COLUMNS = _PAGE.split(", ")


@query(f"select {_PAGE} from viewer_feed order by published_ms desc, activity_id desc limit 21")
def visible_feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.page_desc(viewer_feed(spark, sf_dir), feed.PAGE_SIZE).select(*_PAGE_COLUMNS)


@query(
    f"select {_PAGE} from viewer_feed order by published_ms desc, activity_id desc limit 21 offset 20"
)
def visible_feed_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = feed.PAGE_SIZE
    first = feed.page_desc(viewer_feed(spark, sf_dir), n).collect()
    _, _, key = feed.page_state(first, n)
    return feed.page_desc(viewer_feed(spark, sf_dir), n, key).select(*_PAGE_COLUMNS)


@query(
    f"""select {_PAGE} from viewer_feed where actor_login in ('user16', 'user2', 'user9', 'user30') and type in ('click', 'view')
    order by published_ms desc, activity_id desc limit 21"""
)
def visible_feed_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, types = ["user16", "user2", "user9", "user30"], ["click", "view"]
    rows = feed.restrict(T.activity(spark, sf_dir), users, types)
    return feed.page_desc(viewer_feed(spark, sf_dir, rows), feed.PAGE_SIZE).select(*_PAGE_COLUMNS)


@query("select type, count(*) as n from viewer_feed group by type")
def visible_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.type_counts(viewer_feed(spark, sf_dir))


@query(
    """select type, case type when 'star' then 0 when 'pr_merged' then 1 else 2 end as pin_rank, count(*) as n,
     row_number() over (order by case type when 'star' then 0 when 'pr_merged' then 1 else 2 end, count(*) desc, type) as place
    from (select case type when 'signup' then 'star' when 'error' then 'pr_merged' else type end as type from viewer_feed) group by type"""
)
def type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    renamed = F.when(kind == "signup", "star").when(kind == "error", "pr_merged").otherwise(kind)
    counts = feed.type_counts(viewer_feed(spark, sf_dir).withColumn("type", renamed))
    return feed.type_order(counts).withColumn("place", F.col("place") + 1)


@query(
    """select s.viewer_id, s.login, u.id, u.last_refreshed_ms, u.created_ms from subscription s join github_user u on u.login = s.login"""
)
def following_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.following_list(T.github_user(spark, sf_dir), T.subscriptions(spark, sf_dir))
    return rows.select("viewer_id", "login", "id", "last_refreshed_ms", "created_ms")


@query(
    """select s.login, u.id, count(f.activity_id) as n, max(f.published_ms) as latest_ms
    from subscription s join github_user u on u.login = s.login left join viewer_feed f on f.actor_login = s.login
    where s.viewer_id = 3 group by s.login, u.id"""
)
def following_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = feed.stats_by(viewer_feed(spark, sf_dir), "actor_login")
    mine = T.subscriptions(spark, sf_dir).filter(F.col("viewer_id") == T.VIEWER)
    listed = feed.following_list(T.github_user(spark, sf_dir), mine)
    merged = feed.with_stats(listed, stats.withColumnRenamed("actor_login", "login"), "login")
    return merged.select("login", "id", "n", "latest_ms")


@query(
    """select s.viewer_id, s.login, coalesce(a.n, 0) as n, a.latest_ms
    from subscription s join github_user u on u.login = s.login
    left join (select actor_login, count(*) as n, max(published_ms) as latest_ms from activity where not hidden group by actor_login) a
     on a.actor_login = s.login"""
)
def following_stats_all_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.following_stats_all(
        T.activity(spark, sf_dir), T.github_user(spark, sf_dir), T.subscriptions(spark, sf_dir)
    ).select("viewer_id", "login", "n", "latest_ms")


@query(
    "select actor_login, count(*) as n, max(published_ms) as latest_ms from viewer_feed group by actor_login"
)
def actor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.stats_by(viewer_feed(spark, sf_dir), "actor_login")


@query(
    "select actor_key, type, count(*) as n, max(published_ms) as latest_ms from activity where not hidden group by actor_key, type"
)
def actor_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.stats_by(feed.base(T.activity(spark, sf_dir)), "actor_key", "type")


@query("select type, count(*) as n, max(published_ms) as latest_ms from activity where not hidden group by type")
def type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.stats_by(feed.base(T.activity(spark, sf_dir)), "type")


_STATS = "(select actor_key, count(*) as n, max(published_ms) as latest_ms from activity where not hidden group by actor_key)"


@query(
    f"""select m.viewer_id, m.actor_key as member_key, cast(sum(a.n) as bigint) as n, max(a.latest_ms) as latest_ms
    from {_STATS} a join membership m on m.key = a.actor_key and m.revision = 'r2' group by m.viewer_id, m.actor_key"""
)
def following_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by canonical member for all viewers, aliases folded, strangers dropped."""
    stats = feed.stats_by(feed.base(T.activity(spark, sf_dir)), "actor_key")
    return feed.summary_by_member(stats, membership(spark, sf_dir))


@query(
    f"""select coalesce(m.actor_key, a.actor_key) as member_key, cast(sum(a.n) as bigint) as n, max(a.latest_ms) as latest_ms
    from {_STATS} a left join membership m on m.key = a.actor_key and m.revision = 'r2' and m.viewer_id = 3
    group by coalesce(m.actor_key, a.actor_key)"""
)
def following_summary_with_strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One viewer's fold; rows of accounts that are not followed keep their own key."""
    stats = feed.stats_by(feed.base(T.activity(spark, sf_dir)), "actor_key")
    mine = membership(spark, sf_dir).filter(F.col("viewer_id") == T.VIEWER)
    return feed.summary_by_member(stats, mine, keep_strangers=True).drop("viewer_id")


T.VIEW_SQL["viewer_summary"] = """
 select m.actor_key, m.login, coalesce(s.n, 0) as n, s.latest_ms from member m
 left join (select k.actor_key, count(*) as n, max(a.published_ms) as latest_ms from activity a
  join membership k on k.key = a.actor_key and k.revision = 'r2' and k.viewer_id = 3
  where not a.hidden and a.published_ms > 1706500000000 group by k.actor_key) s on s.actor_key = m.actor_key
 where m.viewer_id = 3 and m.revision = 'r2'"""


def _viewer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.base(T.activity(spark, sf_dir), 1706500000000)
    mine = membership(spark, sf_dir).filter(F.col("viewer_id") == T.VIEWER)
    stats = feed.summary_by_member(feed.stats_by(rows, "actor_key"), mine)
    listed = T.members(spark, sf_dir).filter(
        (F.col("revision") == T.ACTIVE) & (F.col("viewer_id") == T.VIEWER)
    )
    counts = stats.select(F.col("member_key").alias("actor_key"), "n", "latest_ms")
    return feed.with_stats(listed.select("actor_key", "login"), counts, "actor_key")


@query(
    """select *, row_number() over (order by latest_ms desc nulls last, login, actor_key) - 1 as place
    from (select actor_key, login, n, latest_ms from viewer_summary)"""
)
def following_by_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.following_sorted(_viewer_summary(spark, sf_dir), "latest")


@query(
    """select *, row_number() over (order by login, actor_key) - 1 as place
    from (select actor_key, login, n, latest_ms from viewer_summary)"""
)
def following_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.following_sorted(_viewer_summary(spark, sf_dir), "name")


@query(
    """select type, count(*) as n from activity a where not hidden and exists (
     select 1 from membership k where k.key = a.actor_key and k.viewer_id = 3 and k.revision = 'r2'
      and k.actor_key in (select j.actor_key from membership j where j.viewer_id = 3 and j.revision = 'r2'
       and j.key in ('github:16', 'legacy-atom-login:user30', 'github:2', 'github:9999')))
    group by type"""
)
def statistics_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type for chosen actors, over the (actor, type) aggregate."""
    from rookery.operators import projection

    asked = spark.createDataFrame(
        [(T.VIEWER, k) for k in ("github:16", "legacy-atom-login:user30", "github:2", "github:9999")],
        "viewer_id int, key string",
    )
    mine = T.members(spark, sf_dir).filter(
        (F.col("revision") == T.ACTIVE) & (F.col("viewer_id") == T.VIEWER)
    )
    keys = identity.check_selection(asked, mine).filter(F.col("status") == "authorised")
    cells = feed.stats_by(feed.base(T.activity(spark, sf_dir)), "actor_key", "type")
    return projection.statistics(cells, keys)


@query(
    """select actor_key, type, n, latest_ms from (
     select actor_key, type, count(*) as n, max(published_ms) as latest_ms from activity where not hidden group by actor_key, type)
    where latest_ms >= (select min(latest_ms) from (select max(published_ms) as latest_ms from activity where not hidden
     group by actor_key, type order by latest_ms desc limit 25))"""
)
def top_lanes_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = feed.stats_by(feed.base(T.activity(spark, sf_dir)), "actor_key", "type")
    return ranking.top_with_ties(lanes.filter(F.col("n") > 0), "latest_ms", 25)


@query(
    """select activity_id, type, published_ms from activity
    where not hidden and (type = 'click' or actor_login in ('user16', 'user2', 'user9'))
    order by published_ms desc, activity_id desc limit 40"""
)
def merge_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest over two overlapping lanes, each cut before the merge."""
    rows = feed.base(T.activity(spark, sf_dir)).select("activity_id", "actor_login", "type", "published_ms")
    lanes = [
        rows.filter(F.col("type") == "click"),
        rows.filter(F.col("actor_login").isin("user16", "user2", "user9")),
    ]
    return feed.merge_newest(lanes, 40).select("activity_id", "type", "published_ms")


@query(
    """select viewer_id, activity_id, cast(floor((rank - 1) / 50) as bigint) as page from (
     select m.viewer_id, a.activity_id,
      row_number() over (partition by m.viewer_id order by a.published_ms desc, a.activity_id desc) as rank
     from activity a join membership m on m.key = a.actor_key and m.revision = 'r2' where not a.hidden)"""
)
def paginate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page number of every followed row of every viewer."""
    rows = feed.base(T.activity(spark, sf_dir)).select("activity_id", "actor_key", "published_ms")
    keys = membership(spark, sf_dir).select("viewer_id", F.col("key").alias("actor_key"))
    return feed.paginate_all(rows.join(keys, "actor_key"), ["viewer_id"], 50).select(
        "viewer_id", "activity_id", "page"
    )


@query(
    """select f.activity_id, f.title, d.lang, md5(d.text) as content_md5 from viewer_feed f
    join documents d on d.doc_id = (f.seq - 1) // 10 order by f.published_ms desc, f.activity_id desc limit 20"""
)
def late_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choose ids on narrow rows, then fetch the wide bodies of the chosen ones."""
    docs = T.read(spark, sf_dir, "documents")
    narrow = viewer_feed(spark, sf_dir).select("activity_id", "published_ms", "seq")
    doc = F.floor((F.col("seq") - 1) / 10)
    keyed = narrow.select("activity_id", "published_ms", doc.alias("doc_id")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = keyed.orderBy(*feed.newest_first()).limit(20).drop("published_ms")
    wide = T.activity(spark, sf_dir).select("activity_id", "title")
    bodies = docs.join(chosen, "doc_id").select("activity_id", "lang", "text")
    return feed.materialise_rows(chosen, wide, bodies).select(
        "activity_id", "title", "lang", F.md5("text").alias("content_md5")
    )


@query(
    """select a.activity_id, case when m.key is null then 'not-authorised' else 'found' end as result
    from activity a left join membership m on m.key = a.actor_key and m.viewer_id = 3 and m.revision = 'r2' where not a.hidden"""
)
def authorise_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.authorise(T.activity(spark, sf_dir), membership(spark, sf_dir), T.VIEWER)


T.VIEW_SQL["registered"] = "select n_nationkey as viewer_id from nation"
_TARGETS = "select u.* from github_user u where exists (select 1 from subscription s join registered r on r.viewer_id = s.viewer_id where s.login = u.login)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = T.read(spark, sf_dir, "nation")
    return feed.active_targets(
        T.github_user(spark, sf_dir),
        T.subscriptions(spark, sf_dir),
        nations.select(F.col("n_nationkey").alias("viewer_id")),
    )


@query(_TARGETS)
def active_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir)


_DUE_NOW = T.NOW_MS - 4 * 3_600_000


@query(
    f"""select login, last_refreshed_ms, not coalesce(last_refreshed_ms >= {_DUE_NOW} - 300000, false)
     and not coalesce(refresh_claimed_ms >= {_DUE_NOW} - 600000, false) as due
    from ({_TARGETS}) order by last_refreshed_ms asc nulls first, login limit 50"""
)
def due_for_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = feed.refresh_queue(_targets(spark, sf_dir), _DUE_NOW)
    return queue.select("login", "last_refreshed_ms", "due")


@query(
    f"""select login, created_ms from ({_TARGETS}) where last_refreshed_ms is null order by created_ms, login limit 50"""
)
def first_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.first_refresh_queue(_targets(spark, sf_dir)).select("login", "created_ms")


@query(
    """select distinct concat(type, '_', lower(substr(repo, 1, 1)), 'x') as type,
     concat(upper(substr(type, 1, 1)), substr(type, 2), ' ', upper(substr(lower(repo), 1, 1)), 'x') as label
    from activity where repo <> ''"""
)
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.activity(spark, sf_dir).filter(F.col("repo") != "")
    kind = F.concat(F.col("type"), F.lit("_"), F.lower(F.substring("repo", 1, 1)), F.lit("x"))
    return rows.select(kind.alias("type")).distinct().withColumn("label", V.type_label(F.col("type")))


@query(
    """select case when last_refreshed_ms is null then 'Never'
      when (1706659200000 - last_refreshed_ms) < 60000 then 'Just now'
      when (1706659200000 - last_refreshed_ms) < 3600000 then concat((1706659200000 - last_refreshed_ms) // 60000, 'm ago')
      when (1706659200000 - last_refreshed_ms) < 86400000 then concat((1706659200000 - last_refreshed_ms) // 3600000, 'h ago')
      else concat((1706659200000 - last_refreshed_ms) // 86400000, 'd ago') end as age, count(*) as n
    from github_user group by age"""
)
def refresh_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = V.age_text(F.col("last_refreshed_ms"), F.lit(T.NOW_MS))
    return T.github_user(spark, sf_dir).groupBy(age.alias("age")).agg(F.count("*").alias("n"))


@query(
    """select activity_id, concat(strftime(make_timestamp(published_ms * 1000), '%Y-%m-%dT%H:%M:%S'), '.000Z') as published_iso,
     length(activity_id) between 1 and 1000 as id_ok, cast(json_extract_string(summary, '$.k') as bigint) as k,
     try_cast(cast(seq as varchar) as bigint) as seq_number from activity"""
)
def activity_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, ids, JSON fields and sequence text of every row."""
    return T.activity(spark, sf_dir).select(
        "activity_id",
        V.iso_text(F.col("published_ms")).alias("published_iso"),
        V.valid_id(F.col("activity_id")).alias("id_ok"),
        F.get_json_object("summary", "$.k").cast("long").alias("k"),
        V.sequence_number(F.col("seq").cast("string")).alias("seq_number"),
    )


@query("select c_custkey, lower(replace(c_name, '#', '-')) as login from customer")
def normalize_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  @"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(" "))
    return T.read(spark, sf_dir, "customer").select("c_custkey", X.normalize_login(raw).alias("login"))
