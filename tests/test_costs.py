"""Queries that are refused by their plan, before they run."""

from __future__ import annotations

import pytest

from clearledger.operators.costs import Limits, estimated
from clearledger.operators.readonly_sql import agent_query, run_query
from clearledger.sources.files import scan_table


@pytest.fixture(scope="module", autouse=True)
def tables(spark, folder):
    for name in ("orders", "lineitem", "region"):
        scan_table(spark, folder, name).createOrReplaceTempView(name)


TIGHT = Limits(loop_bytes=10_000)


@pytest.mark.parametrize("query", [
    "SELECT count(*) FROM orders CROSS JOIN lineitem",
    "SELECT count(*) FROM orders, lineitem WHERE o_orderkey < l_orderkey",
    "SELECT count(*) FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_shipdate > o.o_orderdate)",
    "SELECT (SELECT count(*) FROM orders a CROSS JOIN orders b) AS n, r_name FROM region",
])
def test_joins_of_all_pairs_are_refused(spark, query):
    with pytest.raises(ValueError, match="join without equal columns"):
        run_query(spark, query, TIGHT)
    rows, problem = agent_query(spark, query, TIGHT)
    assert rows is None and problem.startswith("Query is too costly: ")


@pytest.mark.parametrize("query", [
    "SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate",
    "SELECT count(*) FROM orders CROSS JOIN region",
    "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) LIMIT 1",
])
def test_queries_within_the_limits_run(spark, query):
    assert run_query(spark, query, TIGHT).count() == 1


def test_whole_scans_are_refused(spark):
    size = estimated(spark.sql("SELECT * FROM lineitem")).scan_bytes
    assert size > 100_000
    assert run_query(spark, "SELECT count(*) FROM lineitem", Limits(scan_bytes=size)).count() == 1
    with pytest.raises(ValueError, match=f"it reads {size} bytes"):
        run_query(spark, "SELECT * FROM lineitem", Limits(scan_bytes=size - 1))


def test_without_limits_nothing_is_refused(spark):
    assert run_query(spark, "SELECT count(*) FROM region a CROSS JOIN region b").first()[0] == 25
