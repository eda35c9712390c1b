"""Queries on tables in which one key holds a third of all rows."""

from __future__ import annotations

import duckdb
import pytest
from comparing import differences

import __spark_entry__ as entry_points
from clearledger.plans.registry import TABLES

HOT = "hash({}) % 3 = 0"
SKEWED = {
    "orders": f"SELECT * REPLACE (CASE WHEN {HOT.format('o_orderkey')} THEN 0 ELSE o_custkey END AS o_custkey)",
    "lineitem": f"""
        SELECT * REPLACE (
            CASE WHEN {HOT.format('l_partkey * 31 + l_orderkey')} THEN 0 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN {HOT.format('l_partkey * 37 + l_orderkey')} THEN 0 ELSE l_suppkey END AS l_suppkey)
    """,
    "events": f"SELECT * REPLACE (CASE WHEN {HOT.format('event_id')} THEN 0 ELSE user_id END AS user_id)",
    # every third conversation becomes part of one long one, with its turns renumbered
    "conversations": f"""
        SELECT CASE WHEN hot THEN 1000000 ELSE conv_id END AS conv_id,
               CASE WHEN hot THEN row_number() OVER (PARTITION BY hot ORDER BY conv_id, turn) - 1
                    ELSE turn END AS turn, role, text
        FROM (SELECT * REPLACE (conv_id + i * 10000 AS conv_id),
                     {HOT.format('conv_id + i * 10000')} AS hot FROM {{}}, range(5) copies(i))
    """,
}

CHECKED = (
    "conversation_prompt", "delta_assembly", "prompt_text", "session_text", "event_frames", "purchase_before_error",
    "events_in_alarms", "request_log", "request_summary", "monthly_trend",
    "kpi_table", "type_report", "load_report", "sql_asof", "sql_join_equi", "sql_join_theta",
    "sql_semi_anti", "sql_lateral", "sql_group_having", "sql_stats", "sql_mode", "sql_string_agg",
    "sql_topk_per_group", "sql_distinct_on", "sql_setops", "sql_subqueries", "sql_distinct",
)


@pytest.fixture(scope="module")
def skewed(folder, tmp_path_factory):
    place = tmp_path_factory.mktemp("skewed")
    with duckdb.connect() as db:
        for table in TABLES:
            source = f"'{folder}/{table}.parquet'"
            sql = SKEWED.get(table, "SELECT *")
            sql = sql.format(source) if "{}" in sql else f"{sql} FROM {source}"
            db.sql(f"COPY ({sql}) TO '{place}/{table}.parquet' (FORMAT parquet)")
    return str(place)


@pytest.mark.parametrize("name", CHECKED)
def test_skewed_tables(spark, skewed, name):
    df = entry_points.queries()[name](spark, skewed)
    assert differences(df, entry_points.oracle_sql()[name], skewed) == ""
