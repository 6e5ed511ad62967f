"""Extraction, text functions and ingestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import text as X
from rookery.operators import extract, ingest, replication
from rookery.plans.catalog import query
from rookery.sources import tables as T

_TEXT = "concat('<p>', text, '</p>')"
_PLAIN = f"trim(regexp_replace(regexp_replace({_TEXT}, '<[^>]*>', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@query(
    f"""select concat('tag:github.com,2008:', source, 'Event/', doc_id) as activity_id, concat('Writer ', doc_id % 150) as actor_name,
     concat('user', doc_id % 150) as login, case when doc_id % 4 <> 0 then cast(doc_id % 150 as varchar) end as feed_id,
     concat('doc ', doc_id, ' & co') as title, concat('https://example.com/org', doc_id % 20, '/repo', doc_id % 7, '/x') as link,
     concat('org', doc_id % 20, '/repo', doc_id % 7) as repo, lower(concat(source, 'Event')) as type,
     epoch_us(make_timestamp(2024, 1, 1 + doc_id % 9, 0, 0, 0)) // 1000 as published_ms,
     nullif(substr({_PLAIN}, 1, 220), '') as summary, md5({_TEXT}) as content_md5, false as bad_date
    from documents"""
)
def extract_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.extract_entries(T.raw_feed(spark, sf_dir), T.NOW_MS)
    return rows.withColumn("content_md5", F.md5("content")).drop("content")


@query(
    """select concat('user', doc_id % 150) as actor_login,
     case when doc_id % 4 <> 0 then concat('github:', doc_id % 150)
      when u.id is not null then concat('github:', u.id) else concat('legacy-atom-login:user', doc_id % 150) end as actor_key,
     count(*) as n
    from documents left join github_user u on u.login = concat('user', doc_id % 150) group by all"""
)
def activities_from_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted entries by canonical actor: feed id, else stored id, else login."""
    entries = extract.extract_entries(T.raw_feed(spark, sf_dir), T.NOW_MS)
    rows = extract.to_activities(entries, T.github_user(spark, sf_dir), "feed-v1", T.NOW_MS)
    return rows.groupBy("actor_login", "actor_key").agg(F.count("*").alias("n"))


@query(
    """select doc_id, case when doc_id % 3 = 0 then 'Alpha' when doc_id % 3 = 1 then '' else null end as title,
     case when doc_id % 2 = 0 then 'https://a.example/alt' else 'https://a.example/any' end as link,
     case doc_id % 4 when 0 then 'own/er' when 1 then null when 2 then 'fall/back' else null end as repo,
     case when doc_id % 5 = 0 then 'unknown' else 'pushevent' end as type
    from documents"""
)
def entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-field functions on entry text with missing, empty and odd parts."""
    doc = F.col("doc_id")
    title = F.when(doc % 3 == 0, "<title type='t'> Alpha\n</title>").when(doc % 3 == 1, "<TITLE></TITLE>")
    link = F.when(
        doc % 2 == 0,
        """<link href="https://a.example/any"/><link rel='alternate' type="x" href='https://a.example/alt'/>""",
    ).otherwise('<link rel="self" href="https://a.example/any"/>')
    entry = F.concat(
        F.lit("<entry>"), F.col("source"), F.coalesce(title, F.lit("")), link, F.lit("</entry>")
    )
    address = F.when(doc % 4 == 0, "https://a.example/own/er/x").when(doc % 4 == 1, "https://a.example/own")
    words = F.when(doc % 4 == 2, "merged fall/back into").otherwise("nothing here")
    made = F.when(doc % 5 == 0, F.concat(F.lit("other/"), doc)).otherwise(
        F.concat(F.lit("tag:github.com,2008:PushEvent/"), doc)
    )
    return T.read(spark, sf_dir, "documents").select(
        "doc_id",
        X.tag_value(entry, "title").alias("title"),
        X.entry_link(entry).alias("link"),
        X.repo_of(address, words).alias("repo"),
        X.type_of(made).alias("type"),
    )


@query(
    """select concat('d', doc_id) as activity_id, case doc_id % 4 when 0 then 1704067200000 + (doc_id % 28) * 86400000 when 1 then 1706918645000 else 1706659200000 end as published_ms,
     doc_id % 4 = 3 as bad_date, md5(text) as content_md5 from documents where doc_id % 7 <> 0"""
)
def publication_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, else updated, else ingestion time; unreadable times are flagged."""
    doc, text = F.col("doc_id"), F.col("text")
    day = F.lpad((doc % 28 + 1).cast("string"), 2, "0")
    time = (
        F.when(doc % 4 == 0, F.concat(F.lit("<published>2024-01-"), day, F.lit("T00:00:00Z</published>")))
        .when(doc % 4 == 1, F.lit("<updated> 2024-02-03T01:04:05+01:00 </updated>"))
        .when(doc % 4 == 2, F.lit("<published></published>"))
        .otherwise(F.lit("<published>31/31/2024</published>"))
    )
    title = F.when(doc % 7 != 0, F.lit("<title>t</title>")).otherwise(F.lit("<title> </title>"))
    safe = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(
        F.lit("<entry a='1'><id>d"), doc, F.lit("</id>"), title, time,
        F.lit("<content>"), safe, F.lit("</content></entry>"),
    )
    raw = T.read(spark, sf_dir, "documents").select(F.lit("x").alias("login"), xml.alias("feed_xml"))
    rows = extract.extract_entries(raw, T.NOW_MS)
    return rows.select("activity_id", "published_ms", "bad_date", F.md5("content").alias("content_md5"))


_NAMED = """replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"""


@query(
    f"""select page_id, md5(concat({_NAMED.format("html")}, ' é', chr(8217), 'A😀&#;&#x;', '&lt;')) as decoded_md5 from pages"""
)
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages with decimal, hexadecimal, broken and doubly escaped references."""
    tail = F.lit(" &#233;&#8217;&#x41;&#x1F600;&#;&#x;&amp;lt;")
    return T.read(spark, sf_dir, "pages").select(
        "page_id", F.md5(X.decode_entities(F.concat("html", tail))).alias("decoded_md5")
    )


@query(
    f"""select page_id, nullif(substr(trim(regexp_replace(regexp_replace({_NAMED.format("html")}, '<[^>]*>', ' ', 'g'),
     '[\\s\\x{{00a0}}]+', ' ', 'g')), 1, 220), '') as summary from pages"""
)
def summarize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "pages").select("page_id", X.summarize_html(F.col("html")).alias("summary"))


_MARKED = """concat('<blockquote> feat(core)!: x</blockquote><a href="/x" target="t">q</a> · ', html)"""
_REWRITE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 {_MARKED},
 '(<blockquote>\s*)([a-zA-Z][\w-]*(?:\([a-zA-Z0-9_./-]+\))?!?):\s*', '\1<strong>\2:</strong> ', 'g'),
 '(href|src)=["''](/)([^"'']*)["'']', '\1="https://code.example\2\3"', 'gi'),
 '<a([^>]*target=)', '<' || chr(1) || '\1', 'gi'),
 '<a', '<a target="_blank" rel="noreferrer"', 'gi'),
 '\s*·\s*', ' ', 'g')"""


@query(f"select page_id, md5(replace({_REWRITE}, '<' || chr(1), '<a')) as html_md5 from pages")
def rewrite_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = '<blockquote> feat(core)!: x</blockquote><a href="/x" target="t">q</a> · '
    html = X.rewrite_html(F.concat(F.lit(lead), "html"), "https://code.example")
    return T.read(spark, sf_dir, "pages").select("page_id", F.md5(html).alias("html_md5"))


_DIRTY = """concat('<form id=1><IFRAME src=x></iframe><p style="a" srcdoc=''b'' class=c>', html, '</form><object/>')"""


@query(
    rf"""select page_id, 'text-clean-v1' as version, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_DIRTY},
     '<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<style\b[^>]*>.*?</style\s*>', '', 'gis'),
     '</?(?:base|embed|form|iframe|object|script|style)\b[^>]*>', '', 'gi'),
     '\s(?:srcdoc|style)\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)', '', 'gi')) as content_md5
    from pages where page_id % 3 <> 0"""
)
def refresh_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only bodies of another cleaner version are cleaned again."""
    stale = F.when(F.col("page_id") % 3 == 0, extract.HTML_CLEANER.version).when(
        F.col("page_id") % 3 == 1, "text-clean-v0"
    )
    lead = """<form id=1><IFRAME src=x></iframe><p style="a" srcdoc='b' class=c>"""
    bodies = T.read(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit(lead), "html", F.lit("</form><object/>")).alias("content"),
        stale.alias("version"),
    )
    return extract.refresh_bodies(bodies).select(
        "page_id", "version", F.md5("content").alias("content_md5")
    )


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store of every third activity, and a batch with all rows twice."""
    rows = T.activity(spark, sf_dir)
    again = rows.withColumn("created_ms", F.col("created_ms") + 1000)
    return rows.filter((F.col("seq") - 1) % 3 == 0), rows.unionByName(again)


@query("select activity_id, actor_key, published_ms, created_ms from activity where (seq - 1) % 3 <> 0")
def ingest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, batch = _deliveries(spark, sf_dir)
    new = ingest.ingest_activity(store, batch)
    return new.select("activity_id", "actor_key", "published_ms", "created_ms")


_MISSING = """select (select max(seq) from activity_change) + row_number() over (order by created_ms, activity_id) as seq,
 source, activity_id, actor_key, created_ms from activity a
 where not exists (select 1 from activity_change c where c.source = a.source and c.activity_id = a.activity_id)"""


@query(_MISSING)
def append_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers for activities the log misses; repeats consume none."""
    rows = T.activity(spark, sf_dir)
    new = ingest.append_changes(T.activity_change(spark, sf_dir), rows.unionByName(rows))
    return new.select("seq", "source", "activity_id", "actor_key", "created_ms")


@query("select source, max(seq) as head_seq, count(*) as n from activity_change group by source")
def head_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.activity_change(spark, sf_dir)
    return log.groupBy("source").agg(F.max("seq").alias("head_seq"), F.count("*").alias("n"))


T.VIEW_SQL["raw_following"] = """
 select c_nationkey as viewer_id, c_custkey as load_order, cast(c_custkey as varchar) as id,
  case when c_custkey % 400 = 7 then 'bad login' else concat('Customer-', c_custkey % 40) end as login from customer"""


def raw_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    login = F.when(key % 400 == 7, "bad login").otherwise(F.concat(F.lit("Customer-"), key % 40))
    return T.read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("viewer_id"),
        key.alias("load_order"),
        key.cast("string").alias("id"),
        login.alias("login"),
    )


@query(
    """select viewer_id, id, lower(login) as login from raw_following r
    where not exists (select 1 from raw_following b where b.viewer_id = r.viewer_id and b.login = 'bad login')
     and load_order = (select max(load_order) from raw_following l where l.viewer_id = r.viewer_id and lower(l.login) = lower(r.login))"""
)
def accepted_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accepted_following(raw_following(spark, sf_dir))


@query(
    """select viewer_id, count(*) as n_rows, count(*) filter (login = 'bad login') as n_bad,
     count(*) filter (login = 'bad login') = 0 as accepted from raw_following group by viewer_id"""
)
def following_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.load_summary(raw_following(spark, sf_dir))


@query(
    """select (seq - 1) // 500 as page, count(*) as n_rows, count(*) filter ((seq - 1) % 1501 = 0) as n_bad,
     count(*) filter ((seq - 1) % 1501 = 0) = 0 as accepted from activity group by page"""
)
def validate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq") - 1
    rows = T.activity(spark, sf_dir).withColumn("page", F.floor(n / 500))
    broken = rows.withColumn("actor_key", F.when(n % 1501 != 0, F.col("actor_key")))
    return ingest.accepted_pages(broken, "feed-v1")


@query(
    """select activity_id, case when (seq - 1) % 3 <> 0 then concat(title, ' v2') else title end as title,
     case when (seq - 1) % 3 <> 1 then cast(seq % 4 as bigint) else 9 end as inserted_revision
    from activity"""
)
def upsert_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-delivered rows take new columns and keep the first-seen revision."""
    rows, n = T.activity(spark, sf_dir), F.col("seq") - 1
    store = rows.filter(n % 3 != 1).withColumn("inserted_revision", F.col("seq") % 4)
    page = rows.filter(n % 3 != 0).withColumn("title", F.concat("title", F.lit(" v2")))
    return ingest.upsert_activity(store, page, 9).select("activity_id", "title", "inserted_revision")


T.VIEW_SQL["known_actor"] = """
 select coalesce('github:' || id, 'legacy-atom-login:' || login) as actor_key,
  case when length(login) % 2 = 0 then null else id end as id, concat('old-', login) as login, concat('https://img.example/', login) as avatar_url
 from github_user where created_ms % 3 <> 0"""


def _known_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = F.concat(F.lit("legacy-atom-login:"), "login")
    return T.github_user(spark, sf_dir).filter(F.col("created_ms") % 3 != 0).select(
        F.coalesce(F.concat(F.lit("github:"), "id"), alias).alias("actor_key"),
        F.when(F.length("login") % 2 != 0, F.col("id")).alias("id"),
        F.concat(F.lit("old-"), "login").alias("login"),
        F.concat(F.lit("https://img.example/"), "login").alias("avatar_url"),
    )


@query(
    """select coalesce(k.actor_key, a.actor_key) as actor_key,
     case when k.login is not null and (k.id is not null or a.actor_id is null) then k.id else a.actor_id end as id,
     case when k.login is not null and (k.id is not null or a.actor_id is null) then k.login else a.actor_login end as login, k.avatar_url
    from known_actor k full join (select distinct actor_key, actor_id, actor_login from activity) a on a.actor_key = k.actor_key"""
)
def actors_from_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.actors_from_activity(_known_actors(spark, sf_dir), T.activity(spark, sf_dir), "seq")


T.VIEW_SQL["shown_member"] = """
 select distinct k.key, m.login, substr(m.actor_key, 8) as actor_id from member m
 join membership k on k.viewer_id = m.viewer_id and k.revision = m.revision and k.actor_key = m.actor_key where m.revision = 'r2'"""


@query(
    """select coalesce(k.actor_key, m.key) as actor_key, case when m.key is not null then m.actor_id else k.id end as id,
     case when m.key is not null then m.login else k.login end as login, k.avatar_url
    from known_actor k full join shown_member m on m.key = k.actor_key"""
)
def actors_from_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = T.members(spark, sf_dir).filter(F.col("revision") == T.ACTIVE)
    shown = shown.withColumn("actor_id", F.substr("actor_key", F.lit(8)))
    shown = shown.withColumn("avatar_url", F.lit(None).cast("string"))
    return ingest.actors_from_members(_known_actors(spark, sf_dir), shown)


@query(
    """select coalesce(u.login, n.login) as login, coalesce(n.id, u.id) as id, u.last_refreshed_ms,
     coalesce(u.created_ms, 1706659200000) as created_ms
    from github_user u full join (select lower(login) as login, max(id) as id from raw_following where login <> 'bad login' group by 1
     union all select distinct login, concat('9', substr(actor_key, 8)) from member where revision = 'r2') n on n.login = u.login"""
)
def upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed accounts enter the account table; known ones only take the new id."""
    loaded = raw_following(spark, sf_dir).filter(F.col("login") != "bad login")
    followed = T.members(spark, sf_dir).filter(F.col("revision") == T.ACTIVE)
    new = loaded.select(F.lower("login").alias("login"), "id").unionByName(
        followed.select("login", F.concat(F.lit("9"), F.substr("actor_key", F.lit(8))).alias("id"))
    )
    return replication.upsert_users(T.github_user(spark, sf_dir), new, T.NOW_MS).drop(
        "refresh_claimed_ms"
    )


@query(
    """select actor_key, activity_id, title from (select *, row_number() over (partition by actor_key order by seq) as n from activity) where n = 1"""
)
def first_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivered activity of every actor."""
    from rookery.operators.ranking import first_by

    rows = T.activity(spark, sf_dir).select("actor_key", "activity_id", "title", "seq")
    return first_by(rows, ["actor_key"], [F.asc("seq")]).drop("seq")


@query(
    """select actor_login, type, activity_id, seq from (select *, row_number() over (partition by actor_login, type order by seq desc) as n from activity) where n = 1"""
)
def last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last delivered activity per login and type, by partial aggregation."""
    from rookery.operators.ranking import last_by

    rows = T.activity(spark, sf_dir).select("actor_login", "type", "activity_id", "seq")
    return last_by(rows, ["actor_login", "type"], ["seq"])
