"""What the guard lets through and what it stops."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from clearledger.operators import readonly_sql as Q
from clearledger.operators import tool_events as E
from clearledger.sources.files import register_views

ACCEPTED = [
    "SELECT count(*) AS n FROM orders",
    "  \n select o_orderkey from orders limit 1 ;  ",
    "WITH a AS (SELECT 1 AS x) SELECT * FROM a",
    "with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select * from r",
    'SELECT "o_orderkey" AS "key" FROM "orders" LIMIT 1',
    "SELECT 'DROP TABLE x; INSERT INTO y' AS text",
    "SELECT 'reflect(java.lang.System) USING' AS text -- closing remark",
    "SELECT 1 AS x /* a; b */",
    "SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY 1",
    "SELECT * FROM orders o JOIN orders p ON o.o_orderkey = p.o_orderkey LIMIT 1",
]
REFUSED = [
    None,
    "",
    "   ",
    "DROP TABLE victims",
    "INSERT INTO victims VALUES (2)",
    "(SELECT 1)",
    "-- note\nSELECT 1",
    "SHOW TABLES",
    "FROM victims INSERT INTO victims SELECT *",
    "WITH a AS (SELECT 2 AS x) INSERT INTO victims SELECT * FROM a",
    "WITH a AS (SELECT 2 AS x) FROM a INSERT INTO victims SELECT x",
    "WITH a AS (SELECT 1 AS x) DELETE FROM victims",
    "SELECT 1; DROP TABLE victims",
    "SELECT 1) x; DROP TABLE victims; SELECT * FROM (SELECT 1",
    "SELECTED",
    "SELECT TRANSFORM (x) USING 'cat' AS (y) FROM victims",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS x",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') AS x",
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') AS x FROM victims",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home') AS x",
    "SELECT 1 AS x WHERE EXISTS (SELECT reflect('java.lang.System', 'lineSeparator') = 'x')",
    "WITH a AS (SELECT 1 AS x) SELECT (SELECT max(reflect('java.lang.System', 'lineSeparator')) FROM a)",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
]


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    register_views(spark, folder, ["orders"])
    place = tmp_path_factory.mktemp("victims")
    spark.sql("DROP TABLE IF EXISTS victims")
    spark.sql(f"CREATE TABLE victims (x INT) USING parquet LOCATION '{place}'")
    spark.sql("INSERT INTO victims VALUES (1)")
    yield
    spark.sql("DROP TABLE victims")


@pytest.mark.parametrize("query", ACCEPTED)
def test_accepted(spark, tables, query):
    assert Q.run_query(spark, query).count() > 0


@pytest.mark.parametrize("query", REFUSED)
def test_refused_and_without_effect(spark, tables, query):
    with pytest.raises(Exception):
        Q.run_query(spark, query)
    assert [r.x for r in spark.table("victims").collect()] == [1]


def test_messages(spark):
    with pytest.raises(ValueError, match="^query is required$"):
        Q.run_query(spark, " ")
    with pytest.raises(ValueError, match="^Only SELECT queries are allowed$"):
        Q.run_query(spark, "DROP TABLE x")


def test_settings_are_put_back(spark, tables):
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    Q.run_query(spark, 'SELECT "o_orderkey" FROM orders')
    with pytest.raises(Exception):
        Q.run_query(spark, "SELECT nothing FROM orders")
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before
    assert spark.sql("SELECT 1 FROM parquet.`/root/testdata/sf0.001/region.parquet`").count() == 5


def test_threads_do_not_lift_each_others_guard(spark, tables):
    files = "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`"

    def attempt(i):
        try:
            return Q.run_query(spark, files if i % 2 else "SELECT 1 AS x") is not None and i % 2 == 0
        except Exception:
            return i % 2 == 1

    with ThreadPoolExecutor(8) as pool:
        assert all(pool.map(attempt, range(64)))


def test_agent_form_never_raises(spark, tables):
    rows, error = Q.agent_query(spark, "SELECT CAST(1.50 AS DECIMAL(5,2)) AS price, DATE'2024-01-02' AS day")
    assert error is None
    assert json.loads(rows.first()[0]) == {"price": "1.50", "day": "2024-01-02"}
    for query in ("DROP TABLE x", "", None):
        assert Q.agent_query(spark, query) == (None, "Only SELECT queries are allowed")
    rows, error = Q.agent_query(spark, "SELECT * FROM no_such_table")
    assert rows is None
    assert error.startswith("Query failed: ")


def test_tool_of():
    assert E.tool_of({"query": None}) == "execute_sql"
    assert E.tool_of({"table_name": "t", "query": ""}) == "execute_sql"
    assert E.tool_of({"table_name": ""}) == "describe_table"
    assert E.tool_of({}) == "list_tables"


def test_answers(spark, tables):
    result = E.answer(spark, {"query": "SELECT max(x) AS x FROM victims"})["result"]
    assert [r.asDict() for r in result.collect()] == [{"x": 1}]
    described = E.answer(spark, {"table_name": "victims"})["result"]
    assert [tuple(r) for r in described["columns"].collect()] == [("x", "integer", True)]
    assert [r.x for r in described["sample_rows"].collect()] == [1]
    listed = {r.table_name: r.columns for r in E.answer(spark, {})["result"].collect()}
    assert [c.asDict() for c in listed["victims"]] == [{"column": "x", "type": "integer"}]
    assert "orders" not in listed


@pytest.mark.parametrize(
    ("event", "error"),
    [
        ({"query": ""}, "query is required"),
        ({"query": "DROP TABLE victims"}, "Only SELECT queries are allowed"),
        ({"table_name": " "}, "table_name is required"),
        ({"table_name": "a b"}, "Invalid table name"),
        ({"table_name": "nowhere"}, "Table 'nowhere' not found in public schema"),
    ],
)
def test_error_answers(spark, tables, event, error):
    assert E.answer(spark, event) == {"error": error}


def test_internal_error(spark):
    assert E.answer(spark, {"query": "SELECT * FROM nowhere"})["error"].startswith("Internal error: ")
    unsupported = E.answer(spark, {"query": "SELECT INTERVAL '1' DAY AS i"})
    assert "not JSON serializable" in unsupported["error"]
