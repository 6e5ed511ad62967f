"""Rule language: three-valued logic, invert, validity, both evaluators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rookery.operators import feed
from rookery.operators import rules as R
from rookery.plans.rule_queries import SAMPLE_RULES, day, group, leaf, rule
from tests.conftest import rows

COLUMNS = "activity_id string, actor_login string, title string, type string, repo string, published_ms long"


@pytest.fixture(scope="module")
def activity(spark):
    data = [
        ("a1", "alice", "alice pushed 100%_done", "push", "owner/example", 1_000),
        ("a2", "alice", "ALICE starred", "star", None, 2_000),
        ("b1", "bob", "", "push", "", 3_000),
    ]
    return spark.createDataFrame(data, COLUMNS)


def outcomes(activity, text):
    value = R.outcome(text, R.activity_fields(activity))
    return {r[0]: r[1] for r in activity.select("activity_id", value).collect()}


@pytest.mark.parametrize(
    ("node", "expected"),
    [
        (leaf("repo", "equals", "owner/example"), ("true", "null", "false")),
        (leaf("repo", "notEqual", "owner/example"), ("false", "null", "true")),
        (leaf("title", "contains", "alice P"), ("true", "false", "false")),
        (leaf("title", "contains", "%_"), ("true", "false", "false")),
        (leaf("title", "contains", "_"), ("true", "false", "false")),
        (leaf("title", "notContains", "ALICE"), ("false", "false", "true")),
        (leaf("title", "startsWith", "alice"), ("true", "true", "false")),
        (leaf("title", "notStartsWith", "alice"), ("false", "false", "true")),
        (leaf("title", "endsWith", "DONE"), ("true", "false", "false")),
        (leaf("repo", "notEndsWith", "example"), ("false", "null", "true")),
        (leaf("repo", "isEmpty"), ("false", "true", "true")),
        (leaf("repo", "isNotEmpty"), ("true", "false", "false")),
        (leaf("content", "contains", "x"), ("null", "null", "null")),
        (leaf("publishedAt", "before", {"__type": "Date", "value": "1970-01-01T00:00:02.000Z"}), ("true", "false", "false")),
        (leaf("publishedAt", "after", {"__type": "Date", "value": "1970-01-01T00:00:02.000Z"}), ("false", "false", "true")),
        (leaf("repo", "equals", "", invert=True), ("true", "null", "false")),
    ],
)
def test_leaf(activity, node, expected):
    assert outcomes(activity, rule(node)) == dict(zip(("a1", "a2", "b1"), expected, strict=True))


def test_invert_counts_on_root_and_cancels_on_nested_group(activity):
    star = leaf("type", "equals", "star")
    plain = ("false", "true", "false")
    flipped = ("true", "false", "true")
    by_id = lambda text: tuple(outcomes(activity, text)[k] for k in ("a1", "a2", "b1"))
    assert by_id(rule(star)) == plain
    assert by_id(rule(star, invert=True)) == flipped
    assert by_id(rule(group("and", star, invert=True))) == plain
    assert by_id(rule(group("and", star, invert=True), invert=True)) == flipped
    assert by_id(rule(leaf("type", "equals", "star", invert=True))) == flipped


@pytest.mark.parametrize(
    "text",
    [
        None,
        "{not json",
        "[]",
        "3",
        json.dumps(group("and")),
        json.dumps(group("xor", leaf("type", "equals", "x"))),
        rule(leaf("type", "resembles", "x")),
        rule(leaf("color", "equals", "x")),
        rule(leaf("type", "equals")),
        rule(leaf("type", "equals", "x", "y")),
        rule(leaf("type", "equals", 3)),
        rule(leaf("type", "isEmpty", "x")),
        rule(leaf("publishedAt", "before", "2024-01-01")),
        rule(leaf("publishedAt", "before", {"__type": "Date", "value": "soon"})),
        rule(leaf("publishedAt", "equals", day("2024-01-01"))),
        rule(leaf("type", "equals", day("2024-01-01"))),
        rule({"type": "Filter", "path": ["type"], "name": "equals", "args": ["x"]}),
        json.dumps(group("and", leaf("type", "equals", "x")) | {"invert": None}),
    ],
)
def test_invalid_rules_are_ignored(activity, text):
    assert R.parse_rule(text) is None
    assert R.canonical_text(text) is None
    assert R.visible(activity, [text]).count() == 3


def test_null_keeps_the_row(activity):
    kept = R.visible(activity, [rule(leaf("repo", "notEqual", "owner/example"))])
    assert rows(kept, "activity_id") == [("a1",), ("a2",)]


def random_group(rng, depth):
    fields = ["title", "repo", "type", "githubUserLogin", "content"]
    words = ["ali", "push", "OWNER", "star", "", "%", "e"]
    conditions = []
    for _ in range(rng.randint(1, 3)):
        if depth and rng.random() < 0.5:
            conditions.append(random_group(rng, depth - 1))
        elif rng.random() < 0.15:
            conditions.append(leaf(rng.choice(fields), rng.choice(R.PRESENCE_OPERATORS), invert=rng.random() < 0.3))
        elif rng.random() < 0.15:
            at = {"__type": "Date", "value": f"1970-01-01T00:00:0{rng.randint(0, 4)}.000Z"}
            conditions.append(leaf("publishedAt", rng.choice(R.DATE_OPERATORS), at))
        else:
            conditions.append(
                leaf(rng.choice(fields), rng.choice(R.VALUE_OPERATORS), rng.choice(words), invert=rng.random() < 0.3)
            )
    return group(rng.choice(["and", "or"]), *conditions, invert=rng.random() < 0.3)


def test_compiled_and_batch_evaluation_agree(spark, activity):
    """The two evaluators give the same verdict for random nested rules."""
    rng = random.Random(7)
    texts = [json.dumps(random_group(rng, 3)) for _ in range(60)] + ["{broken"]
    fields = R.activity_fields(activity)
    expected = {
        (r["activity_id"], text)
        for text in texts
        if (test := R.compile_rule(text, fields)) is not None
        for r in activity.filter(test).select("activity_id").collect()
    }
    table = spark.createDataFrame([(t,) for t in texts], "rule_text string")
    each = activity.withColumn("rule_text", F.explode(F.array(*[F.lit(t) for t in texts])))
    assert table.count() == len(texts)
    hit = each.filter(R.rule_is_true(F.col("rule_text"), R.activity_fields(each)))
    assert {(r["activity_id"], r["rule_text"]) for r in hit.collect()} == expected
    assert expected


@pytest.mark.parametrize(("rows_each", "rules_each"), [(4096, 4096), (1, 7)])
def test_index_over_many_rules_agrees_with_columns(spark, activity, monkeypatch, rows_each, rules_each):
    """Every rule on the rows of its actors, in one block and in many; a hot actor, rows
    of actors without rules, equal leaves in many rules, and broken texts."""
    monkeypatch.setattr(R, "BLOCK_ROWS", rows_each)
    monkeypatch.setattr(R, "BLOCK_RULES", rules_each)
    rng = random.Random(9)
    texts = [json.dumps(random_group(rng, 2)) for _ in range(40)] + ["{broken"]
    keyed = activity.withColumn("actor_key", F.col("actor_login"))
    again = keyed.withColumn("activity_id", F.concat("activity_id", F.lit("-again")))
    keyed = keyed.unionByName(again).unionByName(
        again.limit(1).withColumns({"actor_key": F.lit("nobody"), "activity_id": F.lit("x")})
    )
    actors = [r[0] for r in activity.select("actor_login").distinct().collect()]
    held = [(a, t, k) for a in actors for k, t in enumerate(texts) if (k + len(a)) % 3]
    followed = spark.createDataFrame([(a, a) for a in actors] * 2, "viewer_id string, actor_key string")
    asked = spark.createDataFrame(held, "viewer_id string, rule_text string, rule_id long")
    got = {r.activity_id: set(r.hits) for r in R.with_hits(keyed, followed, asked).collect()}
    want = {r.activity_id: set() for r in keyed.select("activity_id").collect()}
    fields = R.activity_fields(keyed)
    for k, text in enumerate(texts):
        if (test := R.compile_rule(text, fields)) is not None:
            for r in keyed.filter(test).select("activity_id", "actor_key").collect():
                if (r.actor_key, text, k) in held:
                    want[r.activity_id].add(k)
    assert got == want and any(want.values())


def _subtrees(plan):
    yield plan
    children = plan.children()
    for k in range(children.length()):
        yield from _subtrees(children.apply(k))


def test_no_pair_of_row_and_rule_in_the_plan(spark, activity):
    """Rows and rule texts meet in a union, sorted into blocks, and in no join."""
    keyed = activity.withColumn("actor_key", F.col("actor_login"))
    followed = spark.createDataFrame([], "viewer_id string, actor_key string")
    asked = spark.createDataFrame([], "viewer_id string, rule_text string, rule_id long")
    given = [
        tree
        for tree in _subtrees(R.with_hits(keyed, followed, asked)._jdf.queryExecution().optimizedPlan())
        if tree.nodeName() == "Join"
    ]
    names = [str(tree.output()) for tree in given]
    assert names and not any("rule_text" in n and "title" in n for n in names)


def test_rows_go_only_to_rules_whose_text_they_hold(spark, activity, monkeypatch):
    """Blocks that a row is sent to follow from its own values, not from the number of rules."""

    def sent(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("activity_id").drop_null()
            ones = pa.array([[1]] * len(ids), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, ones], ["activity_id", "hits"])

    monkeypatch.setattr(R, "_tried", sent)
    monkeypatch.setattr(R, "BLOCK_RULES", 1)
    keyed = activity.withColumn("actor_key", F.lit("k"))
    texts = [rule(leaf("title", "contains", f"user{k}")) for k in range(50)]
    texts += [rule(leaf("title", "startsWith", "Alice"), leaf("type", "equals", "push"))]
    followed = spark.createDataFrame([(1, "k")], "viewer_id int, actor_key string")
    held = spark.createDataFrame([(1, t, k) for k, t in enumerate(texts)], "viewer_id int, rule_text string, rule_id long")
    got = {r.activity_id: len(r.hits) for r in R.with_hits(keyed, followed, held).collect()}
    assert got == {"a1": 1, "a2": 1, "b1": 0}


def test_anchors_of_a_rule():
    words = lambda text: (lambda found: found and [x["args"][0] for x in found])(R.anchors(R.parse_rule(text)))
    one, two = leaf("type", "equals", "click"), leaf("title", "contains", "User12")
    lacks = leaf("repo", "notContains", "a")
    assert words(rule(one, two, lacks)) == ["User12"]
    assert words(rule(one, two, op="or")) == ["click", "User12"]
    assert words(rule(one, lacks, op="or")) is None and words(rule(lacks)) is None
    assert words(rule(lacks, invert=True)) == ["a"] and words(rule(one, invert=True)) is None
    assert words(rule(group("and", one, invert=True))) == ["click"]
    assert words(rule(leaf("title", "contains", ""))) is None and words(rule(leaf("title", "equals", ""))) == [""]


def test_no_list_of_a_viewers_rules_travels(spark, activity):
    keyed = activity.withColumns({"hidden": F.lit(False), "actor_key": F.col("actor_login")})
    membership = spark.createDataFrame([(1, "alice", "alice")], "viewer_id int, key string, actor_key string")
    table = spark.createDataFrame([(1, rule(leaf("type", "equals", "star")), False)], "viewer_id int, rule_text string, deleted boolean")
    plan = feed.visible_counts_all(keyed, membership, table)._jdf.queryExecution().toString()
    assert "collect_set" not in plan


def test_many_viewers_with_invalid_and_missing_rules(spark, activity):
    activity = activity.withColumn("hidden", F.lit(False)).withColumn(
        "actor_key", F.concat(F.lit("k-"), "actor_login")
    )
    membership = spark.createDataFrame(
        [(1, "k-alice", "k-alice"), (1, "k-bob", "k-bob"), (2, "k-alice", "k-alice")],
        "viewer_id int, key string, actor_key string",
    )
    texts = [
        (1, rule(leaf("type", "equals", "star")), False),
        (1, "{broken", False),
        (2, rule(leaf("repo", "isEmpty")), False),
        (2, rule(leaf("type", "equals", "push")), True),
        (2, None, False),
    ]
    table = spark.createDataFrame(texts, "viewer_id int, rule_text string, deleted boolean")
    counts = rows(feed.visible_counts_all(activity, membership, table))
    pages = rows(feed.visible_newest_all(activity, membership, table, 2), "viewer_id", "activity_id", "position")
    assert counts == [(1, "push", 2, 3000), (2, "push", 1, 1000)]
    assert pages == [(1, "a1", 2), (1, "b1", 1), (2, "a1", 1)]
    assert R.rules_of(table, 2) == [texts[2][1]]


def test_numbers_outside_json_are_invalid():
    assert R.parse_rule(rule(leaf("type", "equals", "x"))[:-1] + ', "meta": {"n": NaN}}') is None


def test_sample_rules_cover_both_kinds():
    valid = [R.parse_rule(text) is not None for text, _ in SAMPLE_RULES]
    assert valid == [sql is not None for _, sql in SAMPLE_RULES]
