"""Rule language: one query per operator, nesting, validity, all viewers at once."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import feed, identity
from rookery.operators import rules as R
from rookery.plans.catalog import add, query
from rookery.sources import tables as T


def leaf(field: str, name: str, *args: Any, invert: bool = False) -> dict[str, Any]:
    node = {"id": f"{field}-{name}", "type": "Filter", "path": [field], "name": name, "args": list(args)}
    return node | ({"invert": True} if invert else {})


def group(op: str, *conditions: dict[str, Any], invert: bool = False) -> dict[str, Any]:
    node = {"id": f"{op}-group", "type": "FilterGroup", "op": op, "conditions": list(conditions)}
    return node | ({"invert": True} if invert else {})


def day(text: str) -> dict[str, str]:
    return {"__type": "Date", "value": f"{text}T00:00:00.000Z"}


def rule(*conditions: dict[str, Any], op: str = "and", invert: bool = False) -> str:
    return json.dumps(group(op, *conditions, invert=invert))


# Sample rules with the SQL predicate each one means (NULL: never hides).
SAMPLE_RULES: list[tuple[str, str | None]] = [
    (rule(leaf("type", "equals", "click")), "type = 'click'"),
    (rule(leaf("title", "contains", "USER12")), "contains(lower(title), 'user12')"),
    (rule(leaf("repo", "startsWith", "ORG1")), "starts_with(lower(repo), 'org1')"),
    (rule(leaf("summary", "endsWith", "7}")), "ends_with(lower(summary), '7}')"),
    (rule(leaf("repo", "isEmpty")), "(repo is null or repo = '')"),
    (rule(leaf("publishedAt", "before", day("2024-01-03"))), "published_ms < 1704240000000"),
    (
        rule(
            leaf("type", "notEqual", "view"),
            group("or", leaf("repo", "contains", "/REPO3"), leaf("githubUserLogin", "endsWith", "9")),
        ),
        "type <> 'view' and (contains(lower(repo), '/repo3') or ends_with(lower(actor_login), '9'))",
    ),
    (
        # The inverted nested group cancels: it means what it says without invert.
        rule(
            leaf("type", "equals", "error"),
            group(
                "or",
                leaf("title", "notContains", "user1"),
                leaf("repo", "equals", "org1/repo1"),
                invert=True,
            ),
        ),
        "type = 'error' and (not contains(lower(title), 'user1') or repo = 'org1/repo1')",
    ),
    (rule(leaf("repo", "notEqual", "org2/repo2")), "repo <> 'org2/repo2'"),
    (
        rule(leaf("type", "equals", "purchase"), leaf("type", "equals", "signup"), op="or", invert=True),
        "not (type = 'purchase' or type = 'signup')",
    ),
    (rule(leaf("title", "contains", "%")), "contains(title, '%')"),
    ("{not json", None),
    (rule(leaf("title", "resembles", "x")), None),
]

T.VIEW_SQL["user_filter"] = f"""
 select n_nationkey as viewer_id, cast(ix as integer) as rule_ix, (n_nationkey * 3 + ix * 5) % 13 = 0 as deleted
 from nation cross join range({len(SAMPLE_RULES)}) t(ix) where (n_nationkey * 3 + ix * 5) % 11 < 2"""
T.VIEW_SQL["rule_hit"] = " union all ".join(
    f"select activity_id, {i} as rule_ix from activity where {sql}"
    for i, (_, sql) in enumerate(SAMPLE_RULES)
    if sql is not None
)


def user_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of all viewers: each viewer holds some of the sample rules."""
    v, ix = F.col("viewer_id"), F.col("rule_ix")
    texts = F.array(*[F.lit(text) for text, _ in SAMPLE_RULES])
    return (
        T.read(spark, sf_dir, "nation")
        .select(F.col("n_nationkey").alias("viewer_id"), F.posexplode(texts).alias("rule_ix", "rule_text"))
        .filter((v * 3 + ix * 5) % 11 < 2)
        .select(
            "viewer_id",
            "rule_ix",
            F.concat(F.lit("rule"), ix).alias("rule_id"),
            F.concat(F.lit("name"), 99 - ix).alias("name"),
            "rule_text",
            (F.lit(T.NOW_MS) + ix).alias("created_ms"),
            ((v * 3 + ix * 5) % 13 == 0).alias("deleted"),
        )
    )


def membership(spark: SparkSession, sf_dir: str, revision: str = T.ACTIVE) -> DataFrame:
    return identity.membership(T.members(spark, sf_dir).filter(F.col("revision") == revision))


# One query per operator --------------------------------------------------------

_OPERATORS: dict[str, tuple[dict[str, Any], str]] = {
    "equals": (leaf("repo", "equals", "org3/repo3"), "repo = 'org3/repo3'"),
    "not_equal": (leaf("repo", "notEqual", "org3/repo3"), "repo <> 'org3/repo3'"),
    "contains": (leaf("repo", "contains", "G1/RE"), "contains(lower(repo), 'g1/re')"),
    "not_contains": (leaf("repo", "notContains", "G1/RE"), "not contains(lower(repo), 'g1/re')"),
    "starts_with": (leaf("repo", "startsWith", "Org1"), "starts_with(lower(repo), 'org1')"),
    "ends_with": (leaf("repo", "endsWith", "O5"), "ends_with(lower(repo), 'o5')"),
    "not_starts_with": (leaf("repo", "notStartsWith", "Org1"), "not starts_with(lower(repo), 'org1')"),
    "not_ends_with": (leaf("repo", "notEndsWith", "O5"), "not ends_with(lower(repo), 'o5')"),
    "is_empty": (leaf("repo", "isEmpty"), "repo is null or repo = ''"),
    "is_not_empty": (leaf("repo", "isNotEmpty"), "repo is not null and repo <> ''"),
    "before": (leaf("publishedAt", "before", day("2024-01-10")), "published_ms < 1704844800000"),
    "after": (leaf("publishedAt", "after", day("2024-01-10")), "published_ms > 1704844800000"),
    "inverted_leaf": (leaf("repo", "contains", "repo1", invert=True), "not contains(lower(repo), 'repo1')"),
    "literal_wildcards": (leaf("title", "contains", "_by%"), "contains(lower(title), '_by%')"),
}


def _register(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = T.activity(spark, sf_dir)
        return rows.select("activity_id", R.outcome(text, R.activity_fields(rows)).alias("outcome"))

    add(
        name,
        run,
        f"select activity_id, coalesce(cast(({sql}) as varchar), 'null') as outcome from activity",
    )


for _name, (_leaf, _sql) in _OPERATORS.items():
    _register(f"rule_{_name}", rule(_leaf), _sql)
_register("rule_nested_groups", SAMPLE_RULES[6][0], SAMPLE_RULES[6][1])
_register("rule_nested_invert", SAMPLE_RULES[7][0], SAMPLE_RULES[7][1])
_register("rule_root_invert", SAMPLE_RULES[9][0], SAMPLE_RULES[9][1])


@query(
    """select type, count(*) as n, count(repo) as n_repo from activity
    where not coalesce(repo <> 'org2/repo2', false) group by type"""
)
def rule_null_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.visible(T.activity(spark, sf_dir), [SAMPLE_RULES[8][0]])
    return kept.groupBy("type").agg(F.count("*").alias("n"), F.count("repo").alias("n_repo"))


@query(
    """select type, count(*) as n from activity where not coalesce(type = 'click', false) group by type"""
)
def rule_invalid_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [SAMPLE_RULES[11][0], SAMPLE_RULES[12][0], SAMPLE_RULES[0][0]]
    return feed.type_counts(R.visible(T.activity(spark, sf_dir), texts))


@query(
    """select d.lang, count(*) as n, cast(sum(length(d.text)) as bigint) as chars from documents d
    where not coalesce((contains(lower(d.text), 'inenan') or not contains(lower(d.text), 'é')) and d.source <> 'src3', false)
    group by d.lang"""
)
def rule_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over whole document texts."""
    text = rule(
        group("or", leaf("content", "contains", "INENAN"), leaf("content", "notContains", "É")),
        leaf("repo", "notEqual", "src3"),
    )
    docs = T.read(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    fields = dict.fromkeys(R.STRING_FIELDS, null) | {
        "content": F.col("text"),
        "repo": F.col("source"),
        "publishedAt": F.lit(None).cast("long"),
    }
    kept = docs.filter(~R.hidden_by([text], fields))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    """select viewer_id, concat('rule', rule_ix) as rule_id, concat('name', 99 - rule_ix) as name, rule_ix < 11 as is_valid,
     row_number() over (partition by viewer_id order by concat('name', 99 - rule_ix), concat('rule', rule_ix)) - 1 as place,
     coalesce(n_rows, 0) as n_rows
    from user_filter left join (
      select m.viewer_id, h.rule_ix, count(*) as n_rows
      from (select distinct viewer_id, key from membership where revision = 'r2') m
      join activity a on a.actor_key = m.key and not a.hidden
      join rule_hit h on h.activity_id = a.activity_id
      group by all) using (viewer_id, rule_ix)
    where not deleted"""
)
def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rules by name with validity, invalid ones included, and the rows of the viewer's
    accounts on which each is true."""
    rules = user_filter(spark, sf_dir)
    counts = feed.rule_counts(T.activity(spark, sf_dir), membership(spark, sf_dir), rules)
    listed = R.list_rules(rules).join(counts, ["viewer_id", "rule_text"], "left")
    n_rows = F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")
    return listed.select("viewer_id", "rule_id", "name", "is_valid", "place", n_rows)


_VISIBLE_PAIRS = """
 select m.viewer_id, a.activity_id, a.actor_key, m.actor_key as member_key, a.type, a.published_ms
 from activity a join membership m on m.key = a.actor_key and m.revision = 'r2'
 where not a.hidden and not exists (
  select 1 from rule_hit h join user_filter f on f.rule_ix = h.rule_ix
  where f.viewer_id = m.viewer_id and not f.deleted and h.activity_id = a.activity_id)"""
T.VIEW_SQL["visible_pair"] = _VISIBLE_PAIRS


@query(
    """select viewer_id, type, count(*) as n, max(published_ms) as latest_ms from visible_pair group by viewer_id, type"""
)
def visible_for_all_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.visible_counts_all(
        T.activity(spark, sf_dir), membership(spark, sf_dir), user_filter(spark, sf_dir)
    )


@query(
    """select viewer_id, activity_id, type, published_ms, position from (
     select *, row_number() over (partition by viewer_id order by published_ms desc, activity_id desc) as position
     from visible_pair) where position <= 20"""
)
def visible_pages_all_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = feed.visible_newest_all(
        T.activity(spark, sf_dir), membership(spark, sf_dir), user_filter(spark, sf_dir), 20
    )
    position = F.col("position").cast("long").alias("position")
    return newest.select("viewer_id", "activity_id", "type", "published_ms", position)


@query(
    """select type, count(*) as n from activity
    where coalesce(published_ms <= 1705000000000, false) or coalesce(seq <= 3000, false) group by type"""
)
def clear_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.activity(spark, sf_dir).withColumn("inserted_revision", F.col("seq"))
    cleared = feed.is_cleared(F.lit(1705000000000), F.lit(3000))
    return feed.type_counts(rows.filter(cleared))


@query(
    """select m.viewer_id, a.type, count(*) as n, max(a.published_ms) as latest_ms
    from activity a join membership m on m.key = a.actor_key and m.revision = 'r2'
    where not a.hidden and not exists (select 1 from customer c where c.c_nationkey = m.viewer_id
     and contains(lower(a.title), concat('user', c.c_custkey))) group by m.viewer_id, a.type"""
)
def visible_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distinct rule for every customer, held by the viewer of its nation, and rows
    without any rule text."""
    text = rule(leaf("title", "contains", "User#"))
    before, after = text.split("#")
    customers = T.read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("viewer_id"),
        F.concat(F.lit(before), F.col("c_custkey"), F.lit(after)).alias("rule_text"),
    )
    nothing = T.read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("viewer_id"), F.lit(None).cast("string").alias("rule_text")
    )
    held = customers.unionByName(nothing).withColumn("deleted", F.lit(False))
    return feed.visible_counts_all(T.activity(spark, sf_dir), membership(spark, sf_dir), held)
