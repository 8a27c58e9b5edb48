"""Every registered query against its DuckDB text on the smallest data, and the shape of every plan."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from seatwise.plans.views import BASE_TABLES
from tools.check import SAME_TYPE, rows_of

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry_module.queries().items() if name not in entry_module.CORPUS_QUERIES}
ORACLES = {name: sql for name, sql in entry_module.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    want = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: SAME_TYPE.get(k) for c, k in df.dtypes} == kinds
    assert rows_of(df.columns, df.collect()) == rows_of(names, want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_nested_loop_and_no_single_task_window(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    lines = plan.splitlines()
    for line, child in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:  # only the end of a global aggregate
            assert re.search(r"(Hash|Object|Sort)Aggregate\(keys=\[\], functions=\[partial_", child), child


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["booking_load"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_totalprice" not in schema and "o_orderpriority" not in schema
    plan = QUERIES["anti_join_chain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    plan = QUERIES["read_executions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan


def test_rank_limits_are_applied_before_the_shuffle(spark):
    plan = QUERIES["trailing_messages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_dishes_are_counted_per_parameter_set_before_they_meet_the_requests(spark):
    plan = QUERIES["find_dishes_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"sum\(n#", plan) and re.search(r"partial_count\(1\)", plan)  # requests add up counts, they do not count items


@pytest.mark.parametrize("name,most", [("check_availability", 11), ("modification_result", 12)])
def test_answers_meet_their_day_without_going_back_to_the_orders(spark, name, most):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") <= most
