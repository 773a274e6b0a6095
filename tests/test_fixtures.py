"""Derived tables as Spark builds them, against the SQL that both engines share."""

import datetime as dt

import pytest

from registry.fixtures import Tables
from registry.queries import commit_labels

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int", "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string",
}
DAY = dt.datetime(2001, 1, 1)
ROWS = {
    "nation": [(0, "X Y", 0), (1, "Z", 0)], "supplier": [(1, "S#1", 0)], "customer": [(1, "c1", 0), (2, "c2", 1), (3, "far", 9), (None, "n", 0)],
    # an order that comes twice, one of a customer without a repository, nulls
    "orders": [(1, 1, DAY, "LOW"), (2, 2, DAY, None), (2, 1, None, "HIGH"), (3, 3, DAY, "LOW"), (4, None, DAY, "LOW"), (None, 1, DAY, "LOW")],
    "part": [(i, f"red part {i}", "t", i) for i in range(1, 70)] + [(2, "again", "t", 3), (None, "n", "t", 1)],
    "lineitem": [(k, p, n, q, 0.05, f) for k, p, n, q, f in [(1, 1, 1, 3.0, "A"), (1, 2, 2, 1.0, "R"), (2, 2, 1, 2.0, None), (2, 3, 2, None, "N"), (3, 1, 1, 1.0, "A"), (None, 1, 1, 1.0, "A"), (2, None, 3, 1.0, "A"), (9, 1, 1, 1.0, "A"), (2, 2, 1, 2.0, None)]],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(ROWS[name], schema).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, folder)


@pytest.mark.parametrize("name", ["commit_files", "stories"])
def test_joins_by_number_give_the_rows_of_the_shared_sql(tables, name):
    found, wanted = getattr(tables, name), tables.fixture(f"fx_{name}")
    assert found.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() > 1


def test_lines_are_not_broadcast(tables):
    plan = tables.commit_files.select("repo_id", "sha", "path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "lpad(cast(l_orderkey" not in plan


def test_parts_are_dealt_out_before_they_become_texts(spark, tables):
    assert tables.fixture("fx_python").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_diffs_are_shortened_before_they_meet_commits(tables):
    plan = commit_labels(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("md5(")
