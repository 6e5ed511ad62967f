"""Every registered query against its SQL twin, and the shape of its plan."""

import pathlib
import re
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

import check

import __spark_entry__ as entry
from rookery.plans import load

SF = "/root/testdata/sf0.001"
QUERIES = load().QUERIES


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql_twin(spark, con, name):
    verdict, _ = check.compare(spark, con, SF, name)
    assert verdict == "ok"


def test_every_query_has_a_twin():
    assert set(load().ORACLE) == set(QUERIES) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream", "maintenance"))])
def test_plan_has_no_pairwise_join_and_no_single_task_window(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    physical = plan[plan.index("== Physical Plan ==") :]
    # A window without PARTITION BY prints an empty partition list before its order.
    for window in re.findall(r"Window \[[^\n]*", physical):
        assert "windowspecdefinition(" in window
        assert not re.search(r"windowspecdefinition\([^,]* (?:ASC|DESC)", window), window


def test_time_bound_of_a_rule_and_of_a_page_reaches_the_scan(spark, tmp_path):
    from rookery.operators import feed
    from rookery.operators import rules as R
    from rookery.plans.rule_queries import day, leaf, rule
    from rookery.sources import tables as T

    path = str(tmp_path / "activity")
    T.activity(spark, SF).write.parquet(path)
    stored = spark.read.parquet(path)
    text = rule(leaf("publishedAt", "after", day("2024-01-10")))
    hit = stored.filter(R.compile_rule(text, R.activity_fields(stored))).select("activity_id")
    page = feed.page_desc(stored.select("activity_id", "published_ms"), 5, (1705000000000, "x"))
    for df in (hit, page):
        plan = df._jdf.queryExecution().toString()
        pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
        assert "published_ms" in pushed
        schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
        assert schema == "activity_id:string,published_ms:bigint"
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["retain_newest", "receipts_newest", "nth_newest", "visible_pages_all_viewers"])
def test_top_n_is_limited_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)
