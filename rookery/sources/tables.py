"""The given tables and the feed-shaped views derived from them.

Each view is a DataFrame over whole input tables. ``VIEW_SQL`` states the same
views as SQL text, for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rookery.functions import values as V

VIEWER = 3
ACTIVE, PREVIOUS = "r2", "r1"
NOW_MS = 1706659200000  # 2024-01-31T00:00:00Z, end of the event range
DAY_MS = 86_400_000


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table. Its schema is read from the file once per process."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_of(read(spark, sf_dir, "events"))


def activity_of(events: DataFrame) -> DataFrame:
    """Events as feed activities; also usable on a streaming source."""
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    login = F.concat(F.lit("user"), user)
    unknown = user % 10 == 0
    return events.select(
        F.concat(F.lit("tag:feed,2024:"), kind, F.lit("/"), event).alias("activity_id"),
        F.lit("feed-v1").alias("source"),
        login.alias("actor_login"),
        F.when(unknown, F.concat(F.lit("legacy-atom-login:"), login))
        .otherwise(F.concat(F.lit("github:"), user))
        .alias("actor_key"),
        F.when(~unknown, user.cast("string")).alias("actor_id"),
        kind.alias("type"),
        F.concat(kind, F.lit(" by User"), user).alias("title"),
        F.when(event % 11 == 0, F.lit(None))
        .when(event % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("org"), user % 20, F.lit("/repo"), event % 7))
        .alias("repo"),
        F.col("props").alias("summary"),
        (event % 97 == 0).alias("hidden"),
        V.epoch_ms(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("published_ms"),
        V.epoch_ms(F.col("ts")).alias("created_ms"),
        (event + 1).alias("seq"),
    )


def github_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, ms = F.col("user_id"), V.epoch_ms(F.col("ts"))
    return (
        read(spark, sf_dir, "events")
        .groupBy(user)
        .agg(F.max(ms).alias("last"), F.min(ms).alias("created_ms"))
        .select(
            F.concat(F.lit("user"), user).alias("login"),
            F.when(user % 10 != 0, user.cast("string")).alias("id"),
            F.when(user % 5 != 0, F.col("last")).alias("last_refreshed_ms"),
            F.when(user % 9 == 0, F.col("last")).alias("refresh_claimed_ms"),
            "created_ms",
        )
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow lists of two revisions, as (viewer, revision, member, aliases).

    A viewer follows an account when their residues agree; written as an
    equi-join on the residue class, so no pair is built that does not match.
    """
    user = F.col("user_id")
    users = (
        read(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .withColumn("residue", F.explode(F.array(*[F.lit(r) for r in (0, 1, 2)])))
        .withColumn("class", F.pmod(F.col("residue") - user * 31, F.lit(7)))
    )
    viewers = (
        read(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey") != 24)
        .select(
            F.col("n_nationkey").alias("viewer_id"),
            F.pmod(F.col("n_nationkey") * 17, F.lit(7)).cast("long").alias("class"),
        )
    )
    revisions = F.when(F.col("residue") == 0, F.array(F.lit(PREVIOUS))).when(
        F.col("residue") == 2, F.array(F.lit(ACTIVE))
    )
    both = F.array(F.lit(PREVIOUS), F.lit(ACTIVE))
    alias = F.concat(F.lit("legacy-atom-login:user"), user)
    old = F.concat(F.lit("legacy-atom-login:old"), user)
    return users.join(viewers, "class").select(
        F.explode(F.coalesce(revisions, both)).alias("revision"),
        "viewer_id",
        F.concat(F.lit("github:"), user).alias("actor_key"),
        F.concat(F.lit("user"), user).alias("login"),
        F.when(user % 4 == 0, F.array(alias, old)).otherwise(F.array(alias)).alias("legacy_keys"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login-based follow edges of the active revision."""
    return (
        members(spark, sf_dir).filter(F.col("revision") == ACTIVE).select("viewer_id", "login")
    )


def activity_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log with planted gaps, orphans and mismatched keys."""
    n = F.col("seq") - 1
    return (
        activity(spark, sf_dir)
        .filter(n % 101 != 0)
        .select(
            "seq",
            "source",
            F.when(n % 107 == 0, F.concat("activity_id", F.lit("/gone")))
            .otherwise(F.col("activity_id"))
            .alias("activity_id"),
            F.when(n % 103 == 0, F.concat("actor_key", F.lit("x")))
            .otherwise(F.col("actor_key"))
            .alias("actor_key"),
            "actor_id",
            "created_ms",
        )
    )


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        activity(spark, sf_dir)
        .groupBy("actor_key")
        .agg(
            (F.count("*") % 5).alias("retention_generation"),
            F.min("seq").alias("compacted_through_seq"),
        )
    )


def feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear watermark per viewer; two viewers of three have one."""
    v = F.col("n_nationkey")
    return (
        read(spark, sf_dir, "nation")
        .filter(v % 3 != 1)
        .select(v.alias("viewer_id"), (F.lit(NOW_MS - 25 * DAY_MS) + v * 3_600_000).alias("cleared_ms"))
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations_of(read(spark, sf_dir, "conversations"))


def mutations_of(conversations: DataFrame) -> DataFrame:
    """Turns as user-state mutations; also usable on a streaming source."""
    conv, turn = F.col("conv_id"), F.col("turn")
    attempt = F.when(turn % 4 == 3, turn - 1).otherwise(turn)
    return conversations.select(
        conv.alias("entity_id"),
        turn.alias("arrival"),
        F.concat(F.lit("m"), conv, F.lit("-"), turn).alias("mutation_id"),
        F.concat(F.lit("a"), conv, F.lit("-"), attempt).alias("attempt_id"),
        F.when(turn % 3 == 2, turn - 2).otherwise(turn).alias("base_version"),
        F.when((conv % 5 == 0) & (turn == 4), F.lit("delete"))
        .otherwise(F.lit("put"))
        .alias("kind"),
        F.col("role").alias("name"),
        F.col("text").alias("value"),
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed documents: one titled entry with the whole text, one without a title."""
    doc, text = F.col("doc_id"), F.col("text")
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(
        F.when(
            doc % 4 != 0,
            F.concat(
                F.lit('<media:thumbnail url="https://avatars.githubusercontent.com/u/'),
                doc % 150,
                F.lit('?s=30"/>'),
            ),
        ).otherwise(F.lit("")),
        F.lit("<entry><id>tag:github.com,2008:"),
        F.col("source"),
        F.lit("Event/"),
        doc,
        F.lit("</id><published>2024-01-0"),
        1 + doc % 9,
        F.lit('T00:00:00Z</published><link href="https://example.com/other"/>'),
        F.lit('<link rel="alternate" href="https://example.com/org'),
        doc % 20,
        F.lit("/repo"),
        doc % 7,
        F.lit('/x"/><author><name>Writer '),
        doc % 150,
        F.lit("</name></author><title>doc "),
        doc,
        F.lit(' &amp; co</title><content type="html">&lt;p&gt;'),
        escaped,
        F.lit("&lt;/p&gt;</content></entry><entry><id>no-title/"),
        doc,
        F.lit("</id></entry>"),
    )
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("user"), doc % 150).alias("login"), doc.alias("doc_id"), xml.alias("feed_xml")
    )


# The same views as SQL text. A view may use the views above it.
VIEW_SQL: dict[str, str] = {
    "activity": """
 select concat('tag:feed,2024:', event_type, '/', event_id) as activity_id, 'feed-v1' as source,
  concat('user', user_id) as actor_login,
  case when user_id % 10 = 0 then concat('legacy-atom-login:user', user_id) else concat('github:', user_id) end as actor_key,
  case when user_id % 10 = 0 then null else cast(user_id as varchar) end as actor_id,
  event_type as type, concat(event_type, ' by User', user_id) as title,
  case when event_id % 11 = 0 then null when event_id % 13 = 0 then ''
   else concat('org', user_id % 20, '/repo', event_id % 7) end as repo,
  props as summary, event_id % 97 = 0 as hidden,
  (epoch_us(date_trunc('hour', ts)) // 1000) as published_ms, (epoch_us(ts) // 1000) as created_ms, event_id + 1 as seq
 from events""",
    "github_user": """
 select concat('user', user_id) as login, case when user_id % 10 = 0 then null else cast(user_id as varchar) end as id,
  case when user_id % 5 = 0 then null else max(epoch_us(ts) // 1000) end as last_refreshed_ms,
  case when user_id % 9 = 0 then max(epoch_us(ts) // 1000) else null end as refresh_claimed_ms,
  min(epoch_us(ts) // 1000) as created_ms
 from events group by user_id""",
    "member": """
 select r.revision, v.n_nationkey as viewer_id, concat('github:', u.user_id) as actor_key, concat('user', u.user_id) as login,
  concat('legacy-atom-login:user', u.user_id) as alias_1,
  case when u.user_id % 4 = 0 then concat('legacy-atom-login:old', u.user_id) else null end as alias_2
 from (select distinct user_id from events) u cross join (select n_nationkey from nation) v
 cross join (select 'r1' as revision, 0 as lo, 1 as hi union all select 'r2', 1, 2) r
 where (u.user_id * 31 + v.n_nationkey * 17) % 7 between r.lo and r.hi and v.n_nationkey <> 24""",
    "subscription": "select viewer_id, login from member where revision = 'r2'",
    "membership": """
 select revision, viewer_id, actor_key, actor_key as key from member
 union all select revision, viewer_id, actor_key, alias_1 from member
 union all select revision, viewer_id, actor_key, alias_2 from member where alias_2 is not null""",
    "activity_change": """
 select seq, source, case when (seq - 1) % 107 = 0 then concat(activity_id, '/gone') else activity_id end as activity_id,
  case when (seq - 1) % 103 = 0 then concat(actor_key, 'x') else actor_key end as actor_key, actor_id, created_ms
 from activity where (seq - 1) % 101 <> 0""",
    "retention": """
 select actor_key, cast(count(*) % 5 as bigint) as retention_generation, min(seq) as compacted_through_seq
 from activity group by actor_key""",
    "feed_state": """
 select n_nationkey as viewer_id, 1704499200000 + n_nationkey * 3600000 as cleared_ms from nation where n_nationkey % 3 <> 1""",
    "mutation": """
 select conv_id as entity_id, turn as arrival, concat('m', conv_id, '-', turn) as mutation_id,
  case when turn % 4 = 3 then concat('a', conv_id, '-', turn - 1) else concat('a', conv_id, '-', turn) end as attempt_id,
  case when turn % 3 = 2 then turn - 2 else turn end as base_version,
  case when conv_id % 5 = 0 and turn = 4 then 'delete' else 'put' end as kind, role as name, text as value
 from conversations""",
    "raw_feed": """
 select concat('user', doc_id % 150) as login, doc_id, concat(
  case when doc_id % 4 <> 0 then concat('<media:thumbnail url="https://avatars.githubusercontent.com/u/', doc_id % 150, '?s=30"/>') else '' end,
  '<entry><id>tag:github.com,2008:', source, 'Event/', doc_id, '</id><published>2024-01-0', 1 + doc_id % 9,
  'T00:00:00Z</published><link href="https://example.com/other"/>',
  '<link rel="alternate" href="https://example.com/org', doc_id % 20, '/repo', doc_id % 7,
  '/x"/><author><name>Writer ', doc_id % 150, '</name></author><title>doc ', doc_id,
  ' &amp; co</title><content type="html">&lt;p&gt;', replace(replace(text, '&', '&amp;'), '<', '&lt;'),
  '&lt;/p&gt;</content></entry><entry><id>no-title/', doc_id, '</id></entry>') as feed_xml
 from documents""",
}


def oracle(sql: str) -> str:
    """Prefix ``sql`` with the views it names, directly or through another view."""
    import re

    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(VIEW_SQL[name])

    visit(sql)
    views = ", ".join(f"{n} as ({VIEW_SQL[n]})" for n in VIEW_SQL if n in wanted)
    if not views:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"
