"""Feed, following, paging and extraction on small literal tables."""

import pytest
from pyspark.sql import functions as F

from rookery.functions import text as X
from rookery.functions import values as V
from rookery.operators import extract, feed, identity, ingest, ranking
from rookery.plans.rule_queries import leaf, rule
from tests.conftest import rows

ACTIVITY = "activity_id string, actor_login string, title string, type string, repo string, hidden boolean, published_ms long"


@pytest.fixture(scope="module")
def tables(spark):
    activity = spark.createDataFrame(
        [
            ("alice-push", "alice", "push", "push", None, False, 300),
            ("alice-star", "alice", "star", "star", None, False, 200),
            ("bob-star", "bob", "star", "star", None, False, 100),
            ("carol-push", "carol", "push", "push", None, False, 400),
            ("bob-hidden", "bob", "x", "push", None, True, 500),
        ],
        ACTIVITY,
    )
    users = spark.createDataFrame([("alice", "1"), ("bob", "2"), ("carol", "3")], "login string, id string")
    subs = spark.createDataFrame([(1, "alice"), (1, "bob"), (2, "carol")], "viewer_id int, login string")
    return activity, users, subs


def test_rows_counts_and_following_agree(tables):
    activity, users, subs = tables
    stars = [rule(leaf("type", "equals", "star"))]
    seen = feed.visible_feed(activity, users, subs, 1, stars)
    assert rows(seen, "activity_id") == [("alice-push",)]
    assert rows(feed.type_counts(seen)) == [("push", 1)]
    stats = feed.stats_by(seen, "actor_login").withColumnRenamed("actor_login", "login")
    mine = feed.following_list(users, subs.filter("viewer_id = 1"))
    assert rows(feed.with_stats(mine, stats, "login"), "login", "n", "latest_ms") == [
        ("alice", 1, 300),
        ("bob", 0, None),
    ]


def test_watermark_is_exclusive(tables):
    activity, users, subs = tables
    seen = feed.visible_feed(activity, users, subs, 1, [], cleared_ms=200)
    assert rows(seen, "activity_id") == [("alice-push",)]


def test_pages_concatenate_to_the_ordered_list(spark):
    data = [(f"id{i:03}", "a", "t", "x", None, False, (i * 7) % 5) for i in range(23)]
    df = spark.createDataFrame(data, ACTIVITY)
    everything = [r["activity_id"] for r in df.orderBy(*feed.newest_first()).collect()]
    got, key = [], None
    while True:
        page = feed.page_desc(df, 5, key).orderBy(*feed.newest_first()).collect()
        kept, more, key = feed.page_state(page, 5)
        got += [r["activity_id"] for r in kept]
        if not more:
            break
    assert got == everything
    paged = feed.paginate_all(df.withColumn("g", F.lit(1)), ["g"], 5)
    by_page = {r["activity_id"]: r["page"] for r in paged.collect()}
    assert [by_page[i] for i in everything] == [n // 5 for n in range(23)]


def test_numbering_spreads_one_hot_group(spark):
    """One group holding nearly all rows is numbered over several range partitions."""
    df = spark.range(5000).select(F.when(F.col("id") < 10, F.lit("cold")).otherwise(F.lit("hot")).alias("g"), "id")
    ranked = ranking.numbered_within(df.repartition(7), ["g"], [F.desc("id")])
    bad = ranked.filter(
        F.col("rank") != F.when(F.col("g") == "hot", 4999 - F.col("id")).otherwise(9 - F.col("id"))
    )
    assert bad.count() == 0 and ranked.count() == 5000


def test_lanes_merge_and_cut_with_ties(spark):
    lane = lambda *ids: spark.createDataFrame([(f"{n}-{t}", t) for n, t in ids], "activity_id string, published_ms long")
    merged = feed.merge_newest([lane(("a", 30), ("a", 10)), lane(("b", 40), ("b", 20), ("a", 30))], 4)
    assert [r[0] for r in merged.collect()] == ["b-40", "a-30", "b-20", "a-10"]
    cells = spark.createDataFrame([("x", 9), ("y", 7), ("z", 7), ("w", 1)], "k string, latest_ms long")
    assert rows(ranking.top_with_ties(cells, "latest_ms", 2), "k") == [("x",), ("y",), ("z",)]
    assert rows(ranking.top_with_ties(cells, "latest_ms", 9), "k") == [("w",), ("x",), ("y",), ("z",)]
    assert ranking.top_with_ties(cells, "latest_ms", 0).count() == 0


def test_following_sort_puts_silent_members_last(spark):
    df = spark.createDataFrame([("k1", "b", None), ("k2", "a", None), ("k3", "c", 5)], "actor_key string, login string, latest_ms long")
    assert [r["login"] for r in feed.following_sorted(df, "latest").collect()] == ["c", "a", "b"]
    assert [r["login"] for r in feed.following_sorted(df, "name").collect()] == ["a", "b", "c"]


def test_type_order_pins_first(spark):
    df = spark.createDataFrame([("push", 9), ("pr_merged", 1), ("star", 2), ("fork", 9)], "type string, n long")
    assert [r["type"] for r in feed.type_order(df).collect()] == ["star", "pr_merged", "fork", "push"]


def test_due_and_queue(spark):
    now = 10_000_000
    df = spark.createDataFrame(
        [
            ("fresh", now - 1000, None, 1),
            ("edge", now - feed.COOLDOWN_MS, None, 1),
            ("old", now - feed.COOLDOWN_MS - 1, None, 1),
            ("claimed", None, now - feed.CLAIM_TIMEOUT_MS, 5),
            ("stale-claim", None, now - feed.CLAIM_TIMEOUT_MS - 1, 3),
        ],
        "login string, last_refreshed_ms long, refresh_claimed_ms long, created_ms long",
    )
    queue = [(r["login"], r["due"]) for r in feed.refresh_queue(df, now).collect()]
    assert queue == [("claimed", False), ("stale-claim", True), ("old", True), ("edge", False), ("fresh", False)]
    assert [r["login"] for r in feed.first_refresh_queue(df, 1).collect()] == ["stale-claim"]


def test_statistics_fold_aliases(spark):
    members = spark.createDataFrame([(1, "r", "github:1", "a", ["legacy:a", "legacy:old"])], "viewer_id int, revision string, actor_key string, login string, legacy_keys array<string>")
    stats = spark.createDataFrame([("github:1", 1, 10), ("legacy:old", 1, 20), ("other", 1, 30)], "actor_key string, n long, latest_ms long")
    keys = identity.membership(members)
    assert rows(feed.summary_by_member(stats, keys), "member_key", "n", "latest_ms") == [("github:1", 2, 20)]
    kept = feed.summary_by_member(stats, keys, keep_strangers=True)
    assert rows(kept, "member_key", "n") == [("github:1", 2), ("other", 1)]


def test_entries_of_a_feed(spark):
    xml = """<feed><media:thumbnail height="30" url="https://avatars.githubusercontent.com/u/42?s=30"/>
    <ENTRY x="1"><id>tag:github.com,2008:PushEvent/7</id><updated>2024-01-02T03:04:05Z</updated>
    <link rel="self" href="https://x.example/a"/><link type="t" rel='alternate' href='https://x.example/own/repo/commit'/>
    <title type="html"> A &amp;amp; &lt;b&gt; &#39;q&#39; &#x263A; </title><author><name> Ann </name></author>
    <content>&lt;p&gt;one&nbsp; two&lt;/p&gt;
    three</content></ENTRY>
    <entry><title></title><id>skip</id></entry>
    <entry><id>gone</id></entry>
    <entry><title>fork own2/repo.x now</title><published>not a date</published></entry></feed>"""
    got = extract.extract_entries(spark.createDataFrame([(" @Ann", xml)], "login string, feed_xml string"), 99)
    first, second = sorted(got.collect(), key=lambda r: r["bad_date"])
    assert first["activity_id"] == "tag:github.com,2008:PushEvent/7"
    assert (first["type"], first["repo"], first["actor_name"], first["login"]) == ("pushevent", "own/repo", "Ann", "ann")
    assert first["title"] == "A &amp; <b> 'q' ☺"
    assert first["published_ms"] == 1704164645000 and first["feed_id"] == "42"
    assert first["summary"] == "one two three"
    assert second["bad_date"] and second["repo"] == "own2/repo.x" and second["type"] == "unknown"
    assert second["activity_id"] == "fork own2/repo.x now" and second["summary"] is None
    users = spark.createDataFrame([("ann", "41")], "login string, id string")
    kept = extract.to_activities(got, users, "s", 5)
    assert rows(kept, "activity_id", "actor_key", "actor_id") == [("tag:github.com,2008:PushEvent/7", "github:42", "42")]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(X.decode_entities(F.lit("&#0000000065;&#x000000000041;&#xD83D;"))) == "AA\ufffd"
    for pair in ("&#xD83D;&#xDE00;", "&#x00d83d;&#xde00;", "&#55357;&#56832;", "&#055357;&#56832;"):
        assert value(X.decode_entities(F.lit(f"a{pair}b{pair}{pair}"))) == "a\U0001f600b\U0001f600\U0001f600"
    halves = "&#xDE00;&#xD83D;&#xD83D;&#xDE00;&#xDE00;&#xD83D; &#xDE00;x"
    assert value(X.decode_entities(F.lit(halves))) == "\ufffd\ufffd\U0001f600\ufffd\ufffd \ufffdx"
    assert value(X.decode_entities(F.lit("&amp;#39; &amp;lt; &#x1F600; &#0x; &#99999999; &"))) == "' &lt; \U0001f600 &#0x; &#99999999; &"
    assert value(X.summarize_html(F.lit("<p> </p>"))) is None
    assert value(X.summarize_html(F.lit("<b>" + "x" * 300))) == "x" * 220
    assert value(X.repo_of(F.lit("not a url"), F.lit("see a/b"))) == "a/b"
    assert value(X.repo_of(F.lit(None).cast("string"), F.lit("none"))) is None
    assert value(X.actor_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("ann"))) == "legacy-atom-login:ann"
    assert value(V.type_label(F.lit("pr_review_COMMENT"))) == "Pr Review COMMENT"
    assert value(V.age_text(F.lit(0), F.lit(59_999))) == "Just now"
    assert value(V.age_text(F.lit(0), F.lit(3 * 86_400_000))) == "3d ago"
    assert value(V.sequence_number(F.lit("007"))) is None
    assert value(V.sequence_number(F.lit("9223372036854775807"))) == 2**63 - 1
    assert value(V.sequence_number(F.lit("9223372036854775808"))) is None
    assert value(V.valid_id(F.repeat(F.lit("x"), 1001))) is False
    html = value(X.rewrite_html(F.lit('<a href="/o/r">x</a><a target="t" href=\'/q\'>'), "https://h.example"))
    assert html == '<a target="_blank" rel="noreferrer" href="https://h.example/o/r">x</a><a target="t" href="https://h.example/q">'
    clean = value(X.clean_html(F.lit("<STYLE>a{}</STYLE>k<iframe src=x></iframe><p style='a' class=c onclick=z>t</p>")))
    assert clean == "k<p class=c onclick=z>t</p>"


def test_ingest_is_append_only_and_repeats_use_no_sequence(spark):
    columns = "source string, activity_id string, actor_key string, actor_id string, created_ms long, published_ms long, title string"
    batch = spark.createDataFrame(
        [("s", "new-star", "k", "1", 10, 2, "first"), ("s", "new-star", "k", "1", 11, 2, "again"), ("s", "old-push", "k", "1", 10, 1, "p")],
        columns,
    )
    empty = spark.createDataFrame([], columns)
    stored = ingest.ingest_activity(empty, batch)
    assert rows(stored, "activity_id", "title") == [("new-star", "first"), ("old-push", "p")]
    assert ingest.ingest_activity(stored, batch).count() == 0
    log = spark.createDataFrame([], "seq long, source string, activity_id string, actor_key string, actor_id string, created_ms long")
    one = ingest.append_changes(log, stored)
    assert rows(one, "seq", "activity_id") == [(1, "new-star"), (2, "old-push")]
    assert ingest.append_changes(one, batch).count() == 0
    late = batch.limit(1).withColumn("activity_id", F.lit("late"))
    assert rows(ingest.append_changes(one, late, stored_head=7), "seq") == [(8,)]


def test_bad_rows_reject_the_whole_load(spark):
    raw = spark.createDataFrame(
        [(1, 0, "5", "Ann"), (1, 1, "6", "ann"), (2, 0, "7", "bob"), (2, 1, "9007199254740992", "big"), (3, 0, "1", "with space")],
        "viewer_id int, load_order int, id string, login string",
    )
    assert rows(ingest.accepted_following(raw)) == [(1, "6", "ann")]
    page = spark.createDataFrame([("i", "k", None, "s", 1)], "activity_id string, actor_key string, actor_login string, source string, published_ms long")
    with pytest.raises(ingest.RejectedLoad):
        ingest.require_valid(page, "s")
