"""Queries on read-only SQL, the catalog and tool events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.functions.jsonvalues import rows_as_json
from clearledger.operators import catalog as C
from clearledger.operators import profiles as P
from clearledger.operators import readonly_sql as Q
from clearledger.operators.counts import table_counts
from clearledger.operators.tool_events import answer, dispatch, written_answer
from clearledger.operators.typing import ddl_text, resolve_types, schema_report
from clearledger.plans.load import load_table
from clearledger.plans.registry import SCRATCH, TABLES, query
from clearledger.session import shared_folder
from clearledger.sources.files import register_views, scan_table
from clearledger.sources.small import small_table
from clearledger.sources.tables import ensure_database, quoted
from clearledger.specs import TableSpec

READONLY_SQL = """
    SELECT "o_orderstatus" AS "status", count(*) AS n_orders,
           CAST(sum(CAST("o_totalprice" AS DECIMAL(18,2))) AS DOUBLE) AS "revenue"
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    GROUP BY "o_orderstatus" ORDER BY "o_orderstatus"
"""


@query(READONLY_SQL)
def sql_readonly(spark: SparkSession, folder: str) -> DataFrame:
    register_views(spark, folder, ["orders"])
    return Q.run_query(spark, READONLY_SQL + ";")


JSON_SQL = """
    SELECT o_orderkey, o_orderdate, o_orderpriority,
           CAST(o_totalprice AS DECIMAL(18,2)) AS price,
           CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS buyer
    FROM orders
"""


JSON_MEMBERS = "o_orderkey bigint, o_orderdate string, o_orderpriority string, price {}, buyer bigint"


def _json_fields(rows: DataFrame, price: str) -> DataFrame:
    parsed = rows.select("row_json", F.from_json("row_json", JSON_MEMBERS.format(price)).alias("r"))
    return parsed.select(
        "r.o_orderkey",
        F.col("r.o_orderdate").alias("order_date"),
        F.col("r.price").cast("double").alias("price"),
        "r.buyer",
        F.col("r.o_orderpriority").alias("priority"),
        F.array_join(F.json_object_keys("row_json"), ",").alias("members"),
    )


@query(
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS order_date,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
           CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS buyer, o_orderpriority AS priority,
           'o_orderkey,o_orderdate,o_orderpriority,price,buyer' AS members
    FROM orders
    """
)
def sql_json(spark: SparkSession, folder: str) -> DataFrame:
    register_views(spark, folder, ["orders"])
    return _json_fields(Q.query_as_json(spark, JSON_SQL), "double")


@query(
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
           CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS buyer, o_orderpriority AS priority,
           'o_orderkey,o_orderdate,o_orderpriority,price,buyer' AS members
    FROM orders
    """
)
def sql_json_text(spark: SparkSession, folder: str) -> DataFrame:
    register_views(spark, folder, ["orders"])
    return _json_fields(Q.query_as_json(spark, JSON_SQL, stringify=True), "string")


SCHEMA = "public"


def _catalog(spark: SparkSession, folder: str) -> tuple[C.Catalog, DataFrame]:
    frames = {t: scan_table(spark, folder, t) for t in TABLES}
    catalog = C.catalog_of(spark, {t: df.schema for t, df in frames.items()}, SCHEMA)
    return catalog, table_counts(frames).drop("n_columns")


DUCK_COLUMNS = f"""
    SELECT c.table_name, CAST(ordinal_position AS INTEGER) AS ordinal_position, column_name,
           CASE data_type WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'double precision'
                WHEN 'TIMESTAMP' THEN 'timestamp without time zone' WHEN 'FLOAT[]' THEN 'ARRAY'
                ELSE lower(data_type) END AS data_type
    FROM information_schema.columns c
    WHERE c.table_name IN {TABLES}
"""
DUCK_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)


@query(f"SELECT c.*, r.n_rows FROM ({DUCK_COLUMNS}) c JOIN ({DUCK_ROWS}) r USING (table_name)")
def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    catalog, counts = _catalog(spark, folder)
    return C.list_columns(catalog, SCHEMA).drop("is_nullable").join(counts, "table_name")


@query(
    f"""
    SELECT table_name, any_value(n_rows) AS n_rows,
           'Table: ' || table_name || ' ('
           || string_agg(column_name || ' ' || upper(data_type), ', ' ORDER BY ordinal_position)
           || ')' AS line
    FROM ({DUCK_COLUMNS}) c JOIN ({DUCK_ROWS}) r USING (table_name) GROUP BY table_name
    """
)
def schema_text(spark: SparkSession, folder: str) -> DataFrame:
    catalog, counts = _catalog(spark, folder)
    return C.schema_lines(catalog, SCHEMA).join(counts, "table_name")


@query(
    f"""
    SELECT table_name, any_value(n_rows) AS n_rows, CAST(count(*) AS INTEGER) AS n_columns,
           string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal_position) AS listed
    FROM ({DUCK_COLUMNS}) c JOIN ({DUCK_ROWS}) r USING (table_name) GROUP BY table_name
    """
)
def table_listing(spark: SparkSession, folder: str) -> DataFrame:
    catalog, counts = _catalog(spark, folder)
    listed = F.transform("columns", lambda c: F.concat(c["column"], F.lit(":"), c["type"]))
    return (
        C.list_tables(catalog, SCHEMA)
        .join(counts, "table_name")
        .select(
            "table_name",
            "n_rows",
            F.size("columns").alias("n_columns"),
            F.array_join(listed, ",").alias("listed"),
        )
    )


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 3")
def describe_sample(spark: SparkSession, folder: str) -> DataFrame:
    return C.sample_rows(scan_table(spark, folder, "customer"), order_by=["c_custkey"])


PROFILED = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(*) AS n_rows, count(*) - count({n}) AS n_missing FROM lineitem"
        for n in PROFILED
    )
)
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return C.table_profile(scan_table(spark, folder, "lineitem"))


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{n}' AS column_name, count(*) AS n_rows, count(*) - count({n}) AS n_missing,
               {f"CAST(min({n}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"} AS least_number,
               {f"CAST(max({n}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"} AS greatest_number,
               {"CAST(NULL AS VARCHAR)" if number else f"min(CAST({n} AS VARCHAR))"} AS least_text,
               {"CAST(NULL AS VARCHAR)" if number else f"max(CAST({n} AS VARCHAR))"} AS greatest_text
        FROM lineitem
        """
        for n in PROFILED
        for number in [n not in ("l_returnflag", "l_linestatus", "l_shipdate")]
    )
)
def load_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The exact part of a profile that was brought up to date after each of two loads."""
    lines, root = scan_table(spark, folder, "lineitem"), shared_folder(spark, "profiles")
    early = F.col("l_shipdate") < "2001-01-01"
    for load in (lines.where(early), lines.where(~early | early.isNull())):
        load.write.mode("append").parquet(f"{root}/table")
        table = spark.read.schema(lines.schema).parquet(f"{root}/table")
        profile = P.update_profiles(spark, table, f"{root}/profiles")
    return profile.select(
        "column_name", "n_rows", "n_missing", "least_number", "greatest_number", "least_text", "greatest_text"
    )


def _event_bodies(spark: SparkSession, folder: str) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")

    def body(**members: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(n) for n, v in members.items()]))

    sql = F.concat(F.lit(" select * from events where user_id = "), F.col("user_id").cast("string"))
    bodies = (
        F.when(kind == "click", body(query=sql))
        .when(kind == "error", body(query=F.concat(F.lit("DROP TABLE t"), key.cast("string"))))
        .when((kind == "purchase") & (F.col("value") < 20), F.lit('{"query":null,"table_name":"orders"}'))
        .when(kind == "purchase", F.lit('{"table_name":"orders"}'))
        .when((kind == "signup") & (F.col("value") < 20), F.lit('{"table_name":"no; such"}'))
        .when(kind == "signup", body(table_name=F.concat(F.lit("t_"), F.col("user_id").cast("string"))))
        .when(F.col("value") < 20, F.lit('{"table_name":""}'))
        .when(F.col("value") > 90, F.lit("list the tables"))
        .otherwise(F.lit("{}"))
    )
    return scan_table(spark, folder, "events").select("event_id", bodies.alias("body"))


@query(
    """
    WITH labelled AS (
        SELECT event_id, user_id, event_type AS kind, value < 20 AS small, value > 90 AS broken FROM events
    ), answered AS (
        SELECT event_id,
               CASE WHEN kind = 'view' AND broken THEN NULL
                    WHEN kind IN ('click', 'error') OR (kind = 'purchase' AND small) THEN 'execute_sql'
                    WHEN kind = 'view' AND NOT small THEN 'list_tables' ELSE 'describe_table' END AS tool,
               CASE WHEN kind = 'click' THEN 'select * from events where user_id = ' || user_id
                    WHEN kind = 'error' THEN 'DROP TABLE t' || event_id
                    WHEN kind = 'purchase' AND NOT small THEN 'orders'
                    WHEN kind = 'signup' AND small THEN 'no; such'
                    WHEN kind = 'signup' THEN 't_' || user_id
                    WHEN kind = 'view' AND small THEN '' END AS argument,
               CASE WHEN kind = 'view' AND broken THEN 'Event is not valid JSON'
                    WHEN kind = 'error' THEN 'Only SELECT queries are allowed'
                    WHEN kind = 'purchase' AND small THEN 'query is required'
                    WHEN kind = 'signup' AND small THEN 'Invalid table name'
                    WHEN kind = 'signup' THEN 'Table ''t_' || user_id || ''' not found in public schema'
                    WHEN kind = 'view' AND small THEN 'table_name is required' END AS error
        FROM labelled
    )
    SELECT *, error IS NULL AS ok FROM answered
    """
)
def tool_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    known = small_table(spark, {"table_name": "string"}, [(t,) for t in TABLES])
    return dispatch(_event_bodies(spark, folder), "body", known).drop("body")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS ship_date
    FROM lineitem
    """
)
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = scan_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.col("l_shipdate").alias("ship_date"),
    )
    back = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, ship_date string"
    return rows_as_json(kept).select(F.inline(F.array(F.from_json("row_json", back))))


def _stored_catalog(spark: SparkSession, folder: str) -> str:
    """A database with two loaded tables and a view over one of them."""
    database, root = f"{SCRATCH}_catalog", shared_folder(spark, "catalog")
    ensure_database(spark, database, f"{root}/database")
    for table in ("nation", "orders"):
        load_table(spark, TableSpec(table), folder, database, root)
    seen = quoted(database, "seen")
    spark.sql(f"CREATE OR REPLACE VIEW {seen} AS SELECT n_name FROM {quoted(database, 'nation')}")
    return database


DUCK_STORED = """
    SELECT * FROM (VALUES
        ('nation', 1, 'n_nationkey', 'bigint'), ('nation', 2, 'n_name', 'text'), ('nation', 3, 'n_regionkey', 'bigint'),
        ('orders', 1, 'o_orderkey', 'bigint'), ('orders', 2, 'o_custkey', 'bigint'), ('orders', 3, 'o_orderstatus', 'text'),
        ('orders', 4, 'o_totalprice', 'double precision'), ('orders', 5, 'o_orderdate', 'timestamp without time zone'),
        ('orders', 6, 'o_orderpriority', 'text')
    ) AS stored(table_name, ordinal, column_name, data_type)
"""
DUCK_STORED_ROWS = "SELECT 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders"


def _row_counts(spark: SparkSession, database: str) -> DataFrame:
    """Rows of the base tables that the catalog lists, by reading them."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.tableType != "VIEW"]
    return table_counts({n: spark.table(quoted(database, n)) for n in names}).drop("n_columns")


@query(
    f"""
    SELECT table_name, any_value(n_rows) AS n_rows,
           string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal) AS listed,
           'Table: ' || table_name || ' (' || string_agg(column_name || ' ' || upper(data_type), ', ' ORDER BY ordinal)
           || ')' AS line
    FROM ({DUCK_STORED}) JOIN ({DUCK_STORED_ROWS}) USING (table_name) GROUP BY table_name
    """
)
def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Listing and schema text of a database's base tables, as its catalog has them; the view is left out."""
    database = _stored_catalog(spark, folder)
    catalog = C.session_catalog(spark, database)
    listed = F.transform("columns", lambda c: F.concat(c["column"], F.lit(":"), c["type"]))
    return (
        C.list_tables(catalog, database)
        .select("table_name", F.array_join(listed, ",").alias("listed"))
        .join(C.schema_lines(catalog, database), "table_name")
        .join(_row_counts(spark, database), "table_name")
    )


@query(
    """
    SELECT 'columns' AS part, 'n_nationkey' AS first, 'bigint' AS second, 'true' AS third
    UNION ALL SELECT 'columns', 'n_name', 'text', 'true'
    UNION ALL SELECT 'columns', 'n_regionkey', 'bigint', 'true'
    UNION ALL SELECT 'sample_rows', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)
              FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3)
    UNION ALL SELECT 'error', 'Table ''seen_not'' not found in public schema', NULL, NULL
    UNION ALL SELECT 'error', 'Invalid table name', NULL, NULL
    """
)
def stored_description(spark: SparkSession, folder: str) -> DataFrame:
    """Description of one table of a database, and the answers to names that are not there or not names."""
    database = _stored_catalog(spark, folder)
    described = C.describe_table(spark, "nation", database, order_by=["n_nationkey"])
    texts = ("first", "second", "third")

    def part(name: str, df: DataFrame) -> DataFrame:
        return df.toDF(*texts).select(F.lit(name).alias("part"), *[F.col(c).cast("string").alias(c) for c in texts])

    problems = [answer(spark, {"table_name": t}, database)["error"] for t in ("seen_not", "a b")]
    errors = small_table(spark, dict.fromkeys(texts, "string"), [(p, None, None) for p in problems])
    return part("columns", described.columns).unionByName(part("sample_rows", described.sample_rows)).unionByName(
        part("error", errors)
    )


@query(
    '''
    SELECT 'CREATE TABLE "line ""items""" (' || chr(10) || string_agg('  "' || column_name || '" ' || storage_type, ',' || chr(10)
           ORDER BY ordinal) || chr(10) || ')' AS ddl
    FROM (VALUES (1, 'l_orderkey', 'BIGINT'), (2, 'l_linenumber', 'BIGINT'),
                 (3, 'l_quantity', (SELECT CASE WHEN bool_and(l_quantity % 1 = 0) THEN 'BIGINT'
                                                ELSE 'DOUBLE PRECISION' END FROM lineitem)),
                 (4, 'half ""price""', 'DOUBLE PRECISION'), (5, 'l_returnflag', 'TEXT'), (6, 'l_shipdate', 'TIMESTAMP')
    ) AS report(ordinal, column_name, storage_type)
    '''
)
def ddl_statement(spark: SparkSession, folder: str) -> DataFrame:
    items = scan_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 2 + 0.25).alias('half "price"'),
        "l_returnflag", "l_shipdate",
    )
    report = schema_report(spark, resolve_types(items, TableSpec("lineitem")))
    return ddl_text(report, 'line "items"')


ANSWERED = (
    {"query": "SELECT o_orderkey AS k, 1 AS K, o_orderstatus AS s, o_orderstatus AS s FROM orders WHERE o_orderkey < 40"},
    {"query": "SELECT 1 / (o_orderkey - o_orderkey) AS x FROM orders"},
    {"query": "DELETE FROM orders"},
    {"table_name": "no; such"},
)


@query(
    """
    SELECT 0 AS event_no, 'execute_sql' AS tool, '{"k":' || o_orderkey || ',"K":1,"s":"' || o_orderstatus || '"}' AS row_json,
           NULL AS error
    FROM orders WHERE o_orderkey < 40
    UNION ALL SELECT 1, 'execute_sql', NULL, 'Internal error: [DIVIDE_BY_ZERO]'
    UNION ALL SELECT 2, 'execute_sql', NULL, 'Only SELECT queries are allowed'
    UNION ALL SELECT 3, 'describe_table', NULL, 'Invalid table name'
    """
)
def tool_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as records: rows, an error while rows are computed, and refusals."""
    register_views(spark, folder, ["orders"])
    root = shared_folder(spark, "answers")
    answers = [
        written_answer(spark, event, f"{root}/{i}").select(
            F.lit(i).alias("event_no"), "tool", "row_json",
            F.coalesce(F.regexp_extract("error", r"^[^\[]*\[DIVIDE_BY_ZERO\]", 0), F.lit("")).alias("short"), "error",
        )
        for i, event in enumerate(ANSWERED)
    ]
    rows = reduce(DataFrame.unionByName, answers)
    error = F.when(F.col("short") != "", F.regexp_replace("short", ": .*\\[", ": [")).otherwise(F.col("error"))
    return rows.select("event_no", "tool", "row_json", error.alias("error"))
