"""State, retention, replication, store, streams and maintenance on literals."""

import re

import pytest
from pyspark.sql import functions as F

from rookery import schemas
from rookery.functions import digest
from rookery.operators import identity, ingest, projection, replication, retention, state
from rookery.plans import maintenance
from rookery.plans.rule_queries import leaf, rule
from rookery.session import materialise
from rookery.sources.store import Store, maintain_generation
from rookery.streaming import jobs
from tests.conftest import rows

ACTIVITY = "source string, activity_id string, actor_key string, actor_id string, actor_login string, published_ms long, created_ms long, hidden boolean, type string"
CHANGE = "seq long, source string, activity_id string, actor_key string, actor_id string, created_ms long"
MEMBER = "viewer_id int, revision string, actor_key string, login string, legacy_keys array<string>"


def activity(spark, *items):
    """(id, key, published) rows."""
    data = [("s", i, k, k[-1:], f"user{k[-1:]}", p, p, False, "push") for i, k, p in items]
    return spark.createDataFrame(data, ACTIVITY)


def changes(spark, *items):
    return spark.createDataFrame([(q, "s", i, k, k[-1:], q) for q, i, k in items], CHANGE)


def no_marks(spark):
    return spark.createDataFrame([], schemas.RETENTION)


# Retention -----------------------------------------------------------------------


def test_retention_keeps_the_newest_and_raises_the_floor(spark):
    act = activity(spark, ("a", "k:1", 1), ("b", "k:1", 2), ("c", "k:1", 3), ("d", "k:2", 1))
    log = changes(spark, (1, "a", "k:1"), (2, "b", "k:1"), (3, "c", "k:1"), (4, "d", "k:2"))
    marks = retention.upsert_retention(no_marks(spark), act)
    kept, log2, marks2 = retention.retention_run(act, log, marks, 2)
    assert rows(kept, "activity_id") == [("b",), ("c",), ("d",)]
    assert rows(log2, "seq") == [(2,), (3,), (4,)]
    assert rows(marks2) == [("k:1", 1, 1, 2, "b"), ("k:2", 0, 0, 1, "d")]
    again = retention.retention_run(kept, log2, marks2, 2)
    assert [rows(a) for a in again] == [rows(b) for b in (kept.select(*again[0].columns), log2, marks2)]
    scope = spark.createDataFrame([(1, "k:1"), (1, "k:2"), (2, "k:2")], "viewer_id int, key string")
    asked = spark.createDataFrame([(1, 0), (2, 0)], "viewer_id int, from_seq long")
    assert rows(identity.gap_floor(asked, scope, marks2)) == [(1, 0, 1), (2, 0, None)]


def test_retention_ties_break_by_id(spark):
    act = activity(spark, ("x1", "k:1", 5), ("x2", "k:1", 5), ("x3", "k:1", 5), ("y", "", 1), ("z", "", 1))
    kept = retention.retain_newest(act, 2)
    assert rows(kept, "activity_id") == [("x2",), ("x3",), ("y",), ("z",)]
    assert rows(retention.retain_newest(act, 1), "activity_id") == [("x3",), ("y",), ("z",)]


def test_reconcile_makes_the_audit_clean(spark):
    act = activity(spark, ("a", "", 1), ("b", "github:2", 2), ("c", "github:3", 3))
    log = changes(spark, (1, "b", "wrong:2"), (5, "gone", "github:3"), (6, "blank", ""))
    users = spark.createDataFrame([("user", "9")], "login string, id string")
    audit = retention.audit(act, log, no_marks(spark)).first()
    assert tuple(audit) == (1, 2, 1, 2, 2, False)
    act = retention.normalise_keys(act, users)
    assert rows(act, "activity_id", "actor_key")[0] == ("a", "github:9")
    fixed = retention.repair_changes(log, act)
    assert rows(fixed.filter("repaired"), "seq", "actor_key") == [(1, "github:2")]
    log = fixed.drop("repaired")
    log = log.unionByName(retention.sequence_missing(act, log).select(*log.columns))
    assert rows(log, "seq", "activity_id")[-2:] == [(7, "a"), (8, "c")]
    log, marks = retention.drop_orphans(log, act, retention.upsert_retention(no_marks(spark), act))
    assert rows(marks, "actor_key", "compacted_through_seq", "retention_generation") == [
        ("github:2", 0, 0),
        ("github:3", 5, 1),
        ("github:9", 0, 0),
    ]
    blocked = retention.audit(act, log, marks).first()
    assert tuple(blocked) == (0, 0, 0, 1, 0, False)  # the blank orphan stays
    assert retention.audit(act, log.filter("actor_key <> ''"), marks).first()["ready"]


def test_compaction(spark):
    log = spark.createDataFrame([("u", i) for i in range(1, 6)] + [("v", 9)], "user_id string, seq long")
    receipts = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "c", 2)], "user_id string, attempt_id string, created_ms long")
    floors = spark.createDataFrame([("u", 1), ("v", 0)], "user_id string, floor_seq long")
    kept, newest, raised = retention.compact(log, receipts, floors, 2, 2)
    assert rows(kept) == [("u", 4), ("u", 5), ("v", 9)] or rows(kept, "user_id", "seq") == [("u", 4), ("u", 5), ("v", 9)]
    assert rows(newest, "attempt_id") == [("b",), ("c",)]
    assert rows(raised) == [("u", 3), ("v", 0)]


# Replication -----------------------------------------------------------------------


def test_late_publication_arrives_by_sequence(spark):
    act = activity(spark, ("new", "k:1", 100), ("late", "k:1", 1))
    log = changes(spark, (1, "new", "k:1"), (2, "late", "k:1"))
    keys = spark.createDataFrame([("k:1",)], "key string")
    assert rows(replication.delta_page(log, act, keys, 1, 2, 5), "activity_id") == [("late",)]
    history = replication.history_page(log, act, keys, 2, 5).collect()
    assert [r["activity_id"] for r in history] == ["new", "late"]
    everything = rows(replication.delta_page(log, act, keys, 0, 2, 5), "activity_id")
    assert everything == sorted((r["activity_id"],) for r in history)


def test_transition_equals_a_direct_read_of_the_new_scope(spark):
    act = activity(spark, *[(f"i{n}", f"k:{n % 4}", n) for n in range(40)])
    log = changes(spark, *[(n + 1, f"i{n}", f"k:{n % 4}") for n in range(40)])
    scope = lambda *keys: spark.createDataFrame([(1, f"k:{k}") for k in keys], "viewer_id int, key string")
    old, new = scope(0, 1), scope(1, 2)
    at = spark.createDataFrame([(1, 20)], "viewer_id int, from_seq long")
    moved = replication.scope_transition(log, act, old, new, at, 35)
    start = spark.createDataFrame([(1, 0)], "viewer_id int, from_seq long")
    direct = replication.scope_transition(log, act, scope(), new, start, 35)
    before = replication.scope_transition(log, act, old, old, start, 20)
    held = before.join(new.select(F.col("key")), before["activity_id"].isNotNull(), "left_semi")
    kept = [r for r in held.collect() if int(r["activity_id"][1:]) % 4 == 1]
    got = {r["activity_id"] for r in moved.collect()} | {r["activity_id"] for r in kept}
    assert got == {r["activity_id"] for r in direct.collect()}
    assert moved.count() == moved.select("activity_id").distinct().count()


def test_coverage_heals_after_a_later_end(spark):
    events = [
        ("a", 1, "history", True), ("a", 2, "gap", False),
        ("b", 1, "gap", False), ("b", 2, "history", False), ("b", 3, "history", True),
        ("c", 1, "delta", False), ("d", 1, "history", False),
    ]
    df = spark.createDataFrame(events, "scope string, at long, kind string, is_end boolean")
    assert rows(replication.coverage(df)) == [
        ("a", "may-have-more", "gap-detected"),
        ("b", "exhausted", "continuous"),
        ("c", "unchecked", "continuous"),
        ("d", "may-have-more", "continuous"),
    ]


def test_empty_snapshot_differs_from_a_missing_one(spark):
    snaps = spark.createDataFrame([(1, "r")], "viewer_id int, revision string")
    none = spark.createDataFrame([], MEMBER)
    assert rows(replication.snapshot_members(snaps, none), "viewer_id", "actor_key") == [(1, None)]
    assert replication.snapshot_members(snaps.filter("viewer_id = 2"), none).count() == 0


# Identity ---------------------------------------------------------------------------


def test_one_new_alias_and_one_new_member_are_two_additions(spark):
    old = [(1, "r1", "github:1", "a", ["legacy:a"])]
    new = [(1, "r2", "github:1", "a", ["legacy:a", "legacy:b"]), (1, "r2", "github:2", "c", [])]
    members = spark.createDataFrame(old + new, MEMBER)
    assert rows(identity.additions(members, "r2", "r1"), "key") == [("github:2",), ("legacy:b",)]


def test_signature_ignores_order_and_sees_every_alias(spark):
    sig = lambda *m: identity.membership_signature(spark.createDataFrame(list(m), MEMBER), ["viewer_id"]).first()["signature"]
    a, b = (1, "r", "github:1", "a", ["x", "y"]), (1, "r", "github:2", "b", [])
    assert sig(a, b) == sig(b, (1, "r", "github:1", "renamed", ["y", "x"]))
    assert sig(a, b) != sig((1, "r", "github:1", "a", ["x"]), b)
    assert sig(a, b).startswith("2:")


def test_digest_equals_a_plain_computation(spark):
    import functools
    import hashlib

    lines = [f"line {i}" for i in range(100)]
    got = spark.createDataFrame([(x,) for x in lines], "x string").repartition(5).agg(digest.counted_digest(F.col("x"))).first()[0]
    whole = functools.reduce(lambda a, b: a ^ b, (int(hashlib.sha256(x.encode()).hexdigest(), 16) for x in lines))
    assert got == f"100:{whole:064x}"


def test_signature_of_a_projection_ignores_names(spark):
    sig = spark.createDataFrame([(1, "m")], "viewer_id int, signature string")
    columns = "viewer_id int, rule_id string, name string, rule_text string, deleted boolean"
    text = rule(leaf("type", "equals", "x"))

    def of(*rule_rows):
        return projection.signatures(spark.createDataFrame(list(rule_rows), columns), sig, "v1").first()["signature"]

    base = of((1, "a", "n", text, False))
    assert base == of((1, "a", "other name", text, False), (1, "b", "n", "{broken", False), (1, "c", "n", text, True))
    assert base != of((1, "b", "n", text, False))


# State --------------------------------------------------------------------------------


def test_three_way_merge(spark):
    table = lambda *r: spark.createDataFrame(list(r), "id int, name string, rule string")
    base = table((1, "n", "r"), (2, "n", "r"), (3, "n", "r"), (4, "n", "r"), (5, "n", "r"), (6, "n", "r"))
    local = table((1, "n", "r"), (2, "l", "r"), (3, "l", "r"), (4, "n", "l"), (7, "x", None), (8, "x", "y"), (6, "l", "r"))
    remote = table((1, "n", "r2"), (2, "n", "r2"), (3, "q", "r"), (5, "n", "r"), (7, "x", None), (8, "x", "z"))
    merged = state.three_way_merge(base, local, remote, "id", ["name", "rule"])
    assert rows(merged) == [
        (1, "merged", "n", "r2"),  # only the remote changed
        (2, "merged", "l", "r2"),  # different fields
        (3, "conflict", None, None),  # same field
        (4, "conflict", None, None),  # changed here, removed there
        (5, "deleted", None, None),  # removed here, unchanged there
        (6, "conflict", None, None),
        (7, "merged", "x", None),  # added alike
        (8, "conflict", None, None),  # added differently
    ]
    lists = state.merge_lists(merged, F.when(F.col("id") < 3, F.lit("ok")).otherwise(F.lit("bad")))
    assert rows(lists, "parent", "status") == [("bad", "conflict"), ("ok", "merged")]


def test_overlay_takes_the_last_operation(spark):
    replicas = spark.createDataFrame([("a", "A", False), ("b", "B", False), ("c", "C", True)], "id string, value string, deleted boolean")
    pending = spark.createDataFrame(
        [("a", "delete", None, 1, False), ("a", "put", "A2", 2, False), ("b", "put", "B2", 1, False), ("b", "delete", None, 3, False), ("d", "put", "D", 4, True)],
        "id string, kind string, value string, local_sequence long, conflict_copy boolean",
    )
    assert rows(state.overlay(replicas, pending)) == [("a", "A2", "pending"), ("d", "D", "conflict-copy")]


def test_watermark_only_grows(spark):
    known = spark.createDataFrame([("u", 50, 3), ("w", 90, 1)], "user_id string, cleared_ms long, version long")
    wanted = spark.createDataFrame(
        [("u", 10, 40), ("u", 60, 5), ("w", 10, 20), ("x", None, 7), ("y", 1, 500)],
        "user_id string, anchor_ms long, candidate_ms long",
    )
    assert rows(state.advance_watermark(known, wanted, 100)) == [("u", 60, 4), ("w", 90, 1), ("x", 100, 1), ("y", 100, 1)]


def test_conflict_chain_moves_whole(spark):
    outbox = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "b", 2), (1, 3, "c", 3), (2, 4, "d", 0)], "entity_id long, local_sequence long, attempt_id string, base_version long")
    at = spark.createDataFrame([(1, 2)], "entity_id long, at_sequence long")
    got = {r["local_sequence"]: r for r in state.split_conflicts(outbox, at).collect()}
    assert got[1]["entity_id"] == "1" and not got[1]["conflict_copy"]
    assert got[2]["entity_id"] == got[3]["entity_id"] != "1"
    assert (got[2]["base_version"], got[3]["base_version"]) == (0, 3)
    assert got[3]["attempt_id"] != "c" and got[4]["attempt_id"] == "d"


# Store, streams, maintenance -------------------------------------------------------------


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "x int")
    assert store.read("a") is None
    store.publish({"a": one, "b": one}, signature="s1")
    broken = one.select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        store.publish({"a": one.union(one), "b": broken})
    assert rows(store.read("a")) == [(1,)] and store.current("a")[:2] == (1, "s1")
    store.publish({"a": one.union(one)}, append={"b": one})
    assert store.read("a").count() == 2 and store.read("b").count() == 2
    again = Store(spark, str(tmp_path))
    assert again.current("a")[0] == 2 and len(again.current("b")[2]) == 2
    assert again.read("b").count() == 2


def test_generation_extends_and_rebuilds(spark, tmp_path):
    store, calls = Store(spark, str(tmp_path)), []
    numbers = lambda low, high: spark.range(low + 1, high + 1).agg(F.count("*").alias("n"))

    def run(sig, through):
        return maintain_generation(
            store, "p", sig, through,
            lambda high: calls.append("build") or numbers(0, high),
            lambda low, high: calls.append((low, high)) or numbers(low, high),
            lambda a, b: a.union(b).agg(F.sum("n").alias("n")),
        )

    assert [run("s", 5), run("s", 5), run("s", 9), run("t@x", 9)] == ["rebuilt", "unchanged", "extended", "rebuilt"]
    assert calls == ["build", (5, 9), "build"]
    assert store.read("p").first()["n"] == 9


def test_stream_ingest_is_exactly_once_over_restarts(spark, tmp_path):
    schema = "activity_id string, created_ms long, published_ms long"
    inbox, store, mark = (str(tmp_path / d) for d in ("in", "store", "mark"))
    deliver = lambda *ids: spark.createDataFrame([(i, 1, 1) for i in ids], schema).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        jobs.stream_ingest(source, store, mark)
        return rows(jobs.read_all(spark, store, source.schema), "activity_id")

    deliver("a", "b", "a")
    assert run() == [("a",), ("b",)]
    deliver("b", "c")
    deliver("c", "d")
    assert run() == [("a",), ("b",), ("c",), ("d",)]
    assert run() == [("a",), ("b",), ("c",), ("d",)]


def test_mutation_stream_carries_state_between_runs(spark, tmp_path):
    """Tombstones, re-sent attempts and null attempts over restarts; receipts that end."""
    inbox, root, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def deliver(*steps, receipt_ms=10**9):
        data = [(e, t, f"m{t}", a, b, kind, "n", "v") for e, t, a, b, kind in steps]
        spark.createDataFrame(data, schemas.MUTATION).coalesce(1).write.mode("append").parquet(inbox)
        source = spark.readStream.schema(schemas.MUTATION).parquet(inbox)
        jobs.stream_mutations(source, root, mark, receipt_ms)
        got = jobs.read_all(spark, f"{root}/results", schemas.MUTATION_RESULT)
        return {r.arrival: (r.outcome, r.version, r.deleted) for r in got.collect()}

    deliver((1, 1, "b", 1, "put"), (1, 0, "a", 0, "put"), (2, 2, "x", 0, "put"), (3, 3, None, 0, "put"))
    got = deliver((1, 4, "b", 1, "put"), (1, 5, "c", 1, "put"), (2, 6, "y", 1, "delete"), (3, 7, None, 0, "put"))
    assert got == {
        0: ("applied", 1, False), 1: ("applied", 2, False), 2: ("applied", 1, False), 3: ("applied", 1, False),
        4: ("already-applied", 2, False), 5: ("conflict", 2, False), 6: ("applied", 2, True), 7: ("conflict", 1, False),
    }
    got = deliver((1, 8, "d", 2, "put"), (2, 9, "z", 2, "put"), (2, 10, "y", 2, "delete"), (1, 11, "a", 3, "put"), receipt_ms=1)
    assert [got[k] for k in (8, 9, 10, 11)] == [
        ("applied", 3, False), ("conflict", 2, True), ("already-applied", 2, True), ("already-applied", 3, False)
    ]
    # The timer of the last delivery ends all receipts of entity 1; its row still knows "d".
    deliver((5, 12, "p", 0, "put"), receipt_ms=1)
    got = deliver((1, 13, "d", 3, "put"), (1, 14, "a", 3, "put"), receipt_ms=1)
    assert got[13] == ("already-applied", 3, False) and got[14] == ("applied", 4, False)


def test_member_statistics_follow_aliases_between_runs(spark, tmp_path):
    """After each run the member level equals a recount under the membership of that run."""
    root, mark, inbox = (str(tmp_path / n) for n in ("root", "mark", "in"))
    stored: list[tuple] = []

    def run(new, membership):
        data = [(f"a{len(stored) + k}", key, "t", at, False) for k, (key, at) in enumerate(new)]
        stored.extend(data)
        schema = "activity_id string, actor_key string, type string, published_ms long, hidden boolean"
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(inbox)
        keys = spark.createDataFrame(membership, jobs.MEMBERSHIP)
        jobs.stream_levels(spark.readStream.schema(schema).parquet(inbox), keys, root, mark)
        want = {}
        for viewer, key, member in set(membership):
            for _, actor, _, at, _ in stored:
                if actor == key:
                    n, latest = want.get((viewer, member), (0, 0))
                    want[viewer, member] = (n + 1, max(latest, at))
        got = {(r.viewer_id, r.member_key): (r.n, r.latest_ms) for r in jobs.member_stats(spark, root).collect()}
        assert got == want
        return got

    run([("x", 5), ("x", 9), ("old-x", 20), ("y", 1)], [(1, "x", "x"), (1, "y", "y"), (2, "y", "y")])
    # An alias is found, a member leaves, another viewer follows; no new activity of them.
    got = run([("z", 3)], [(1, "x", "x"), (1, "old-x", "x"), (2, "y", "y"), (2, "x", "x")])
    assert got[1, "x"] == (3, 20) and (1, "y") not in got
    # The alias goes again: the latest time falls back; a repeated row is no second key.
    got = run([], [(1, "x", "x"), (1, "x", "x"), (3, "z", "z")])
    assert got == {(1, "x"): (2, 9), (3, "z"): (1, 3)}
    run([("x", 30)], [(1, "x", "x")])


def steps(**changed):
    order = []
    plain = {
        "following": lambda: order.append("following") or 3,
        "reconcile": lambda: order.append("reconcile") or True,
        "refresh": lambda: order.append("refresh") or 5,
        "cleanup": lambda: order.append("cleanup") or 1,
        "compact": lambda: order.append("compact") or 0,
    }
    return plain | changed, order


def fail():
    raise RuntimeError("boom")


def test_failed_reconcile_skips_only_the_clean_up(spark):
    for bad in (fail, lambda: False):
        plan, order = steps(reconcile=bad)
        out = maintenance.run_maintenance(spark, plan)
        assert order == ["following", "refresh", "compact"]
        assert ("cleanup", True, "skipped: reconciliation-failed") in rows(out, "step", "ok", "message")
    plan, order = steps(following=fail)
    assert rows(maintenance.run_maintenance(spark, plan), "ok").count((False,)) == 1
    assert order == ["reconcile", "refresh", "cleanup", "compact"]


def test_sequences_are_never_reused_after_the_log_shrinks(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    act = activity(spark, ("a", "github:1", 1), ("b", "github:1", 2))
    log = changes(spark, (1, "a", "github:1"), (2, "b", "github:1"), (9, "gone", "github:1"))
    store.publish({"activity": act, "change": log, "retention": no_marks(spark)})
    users = spark.createDataFrame([("user1", "1")], "login string, id string")
    assert maintenance.reconcile_if_needed(store, users, 1000)
    assert rows(store.read("change"), "seq") == [(1,), (2,)]
    later = activity(spark, ("c", "github:1", 3))
    store.publish(append={"activity": later})
    assert maintenance.reconcile(store, users)
    assert (10, "c") in rows(store.read("change"), "seq", "activity_id")
    assert maintenance.cleanup(store, 1, 1000 + 2 * retention.PROOF_MAX_AGE_MS) == 0  # proof too old
    assert maintenance.cleanup(store, 1, 1001) == 2
    assert rows(store.read("activity"), "activity_id") == [("c",)]
    assert store.read("head").first()["head_seq"] == 10


def exchanged(df):
    """The columns of every exchange in the plan of ``df``."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.findall(r"(\w+)#", found) for found in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]


def entry(i, title, at, body):
    return (
        f"<entry><id>tag:github.com,2008:PushEvent/{i}</id><published>2024-01-0{at}T00:00:00Z</published>"
        f'<title>{title}</title><content type="html">{body}</content></entry>'
    )


def test_refresh_takes_the_body_of_the_kept_entry_and_moves_no_body(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    held = activity(spark, ("tag:github.com,2008:PushEvent/0", "github:1", 1)).withColumns(
        {c: F.lit(None).cast("string") for c in ("title", "link", "repo")}
    )
    empty = spark.createDataFrame([], schemas.ACTIVITY_CHANGE)
    store.publish({"activity": held.select(*schemas.ACTIVITY.names), "change": empty})
    feed = spark.createDataFrame(
        [
            ("user1", entry(0, "stored", 1, "s") + entry(1, "one", 2, "late") + entry(1, "one", 1, "early")),
            # Alike but for the body, then but for the title: the first by name of column wins.
            ("user1", entry(2, "a", 1, "zz") + entry(2, "b", 1, "yy") + entry(2, "c", 1, "yy")),
            ("user2", entry(3, "alone", 1, "whole") + entry(4, "no date", "x", "n")),
        ],
        "login string, feed_xml string",
    )
    users = spark.createDataFrame([("user1", "1"), ("user1", "7")], "login string, id string")
    written = {}

    def spy(df, label="table"):
        written[label] = df
        return materialise(df, label)

    monkeypatch.setattr(maintenance, "materialise", spy)
    assert maintenance.refresh(store, feed, users, "s", 1000) == 3
    body = rows(store.read("body"), "activity_id", "content", "summary")
    assert [(i[-1], c, s) for i, c, s in body] == [("1", "early", "early"), ("2", "yy", "yy"), ("3", "whole", "whole")]
    new = rows(store.read("activity").filter("title is not null"), "activity_id", "title", "actor_key")
    assert [(i[-1], t, k) for i, t, k in new] == [
        ("1", "one", "github:1"), ("2", "b", "github:1"), ("3", "alone", "legacy-atom-login:user2")
    ]
    assert rows(store.read("change"), "seq") == [(1,), (2,), (3,)]
    assert all("content" not in columns for columns in exchanged(written["extracted"]))


def test_ingestion_exchanges_whole_rows_once(spark, tmp_path):
    columns = "activity_id string, created_ms long, published_ms long, content string"
    spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 1, 1, "z")], columns).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    new = ingest.ingest_activity(batch.filter("activity_id = 'b'"), batch)
    assert rows(new, "activity_id", "content") == [("a", "x")]
    assert sum("content" in columns for columns in exchanged(new)) == 1


def test_repair_moves_log_and_activity_once_each(spark, tmp_path):
    act = activity(spark, ("a", "k:1", 1), ("a", "k:1", 1), ("b", "k:2", 2), ("b", "k:2", 2), ("c", "", 3))
    log = changes(
        spark, (1, "a", "k:1"), (2, "a", "k:1"), (3, "gone", "k:1"), (4, "gone", "k:2"), (5, "blank", ""), (6, None, "k:2"), (7, None, "")
    )
    for name, df in (("act", act), ("log", log)):
        df.write.parquet(str(tmp_path / name))
    act, log = (spark.read.parquet(str(tmp_path / name)) for name in ("act", "log"))
    kept, marks = retention.drop_orphans(log, act, retention.upsert_retention(no_marks(spark), act))
    assert rows(kept, "seq") == [(1,), (2,), (5,), (7,)]
    assert rows(marks, "actor_key", "compacted_through_seq") == [("k:1", 3), ("k:2", 6)]
    assert not any("seq" in columns for columns in exchanged(kept))
    assert rows(retention.sequence_missing(act, log), "seq", "activity_id") == [(8, "b")]
