"""Tool events: which tool an event asks for, and its answer."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.functions import jsonvalues as J
from clearledger.functions import text
from clearledger.operators import catalog as C
from clearledger.operators import readonly_sql as Q
from clearledger.sources.small import small_table

# Tool names, the argument that selects each, and messages.
EXECUTE_SQL = "execute_sql"
DESCRIBE_TABLE = "describe_table"
LIST_TABLES = "list_tables"
QUERY_KEY = "query"
TABLE_KEY = "table_name"
INTERNAL_ERROR = "Internal error: "
NOT_AN_EVENT = "Event is not valid JSON"


def tool_of(event: dict[str, Any]) -> str:
    if QUERY_KEY in event:
        return EXECUTE_SQL
    return DESCRIBE_TABLE if TABLE_KEY in event else LIST_TABLES


def answer(spark: SparkSession, event: dict[str, Any], database: str | None = None) -> dict:
    """Answer one event with ``{"result": ...}`` or ``{"error": text}``.

    Results are DataFrames, so the caller decides what leaves the cluster. What
    goes wrong while their rows are computed is raised then; ``written_answer``
    computes them here and reports that as well.
    """
    try:
        tool = tool_of(event)
        if tool == EXECUTE_SQL:
            return {"result": J.json_ready(Q.run_query(spark, event[QUERY_KEY]))}
        if tool == DESCRIBE_TABLE:
            described = C.describe_table(spark, event[TABLE_KEY], database)
            samples = J.json_ready(described.sample_rows)
            return {"result": {"columns": described.columns, "sample_rows": samples}}
        database = database or spark.catalog.currentDatabase()
        return {"result": C.list_tables(C.session_catalog(spark, database), database)}
    except ValueError as problem:
        return {"error": str(problem)}
    except Exception as problem:
        return {"error": f"{INTERNAL_ERROR}{problem}"}


ANSWER_FIELDS = {"tool": "string", "part": "string", "row_json": "string", "error": "string"}


def _rows_of(answered: dict) -> list[tuple[str, DataFrame]]:
    result = answered["result"]
    return list(result.items()) if isinstance(result, dict) else [("rows", result)]


def written_answer(spark: SparkSession, event: dict[str, Any], folder: str, database: str | None = None) -> DataFrame:
    """Answer one event into ``folder`` as records ``tool, part, row_json, error``; returns them.

    The rows are computed by the write, so an error in any of them, like one found
    before, gives a single record with the error's text and no rows.
    """
    tool = tool_of(event)
    answered = answer(spark, event, database)
    if "error" not in answered:
        try:
            for part, rows in _rows_of(answered):
                J.rows_as_json(rows).select(
                    F.lit(tool).alias("tool"), F.lit(part).alias("part"), "row_json",
                    F.lit(None).cast("string").alias("error"),
                ).write.parquet(f"{folder}/{part}")
            parts = [f"{folder}/{part}" for part, _ in _rows_of(answered)]
            return spark.read.parquet(*parts)
        except Exception as problem:
            answered = {"error": f"{INTERNAL_ERROR}{problem}"}
    small_table(spark, ANSWER_FIELDS, [(tool, None, None, answered["error"])]).write.parquet(f"{folder}/error")
    return spark.read.parquet(f"{folder}/error")


def _query_problem(query: Column) -> Column:
    shown = F.coalesce(text.strip(query), F.lit(""))
    starts = [F.upper(shown).startswith(start) for start in Q.QUERY_STARTS]
    return F.when(shown == "", Q.QUERY_REQUIRED).when(~(starts[0] | starts[1]), Q.ONLY_SELECT)


def _table_problem(name: Column, found: Column) -> Column:
    missing = F.concat(F.lit("Table '"), name, F.lit("' not found in public schema"))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", C.NAME_REQUIRED)
        .when(~name.rlike(C.NAME_PATTERN), C.NAME_INVALID)
        .when(found.isNull(), missing)
    )


def dispatch(events: DataFrame, body: str, tables: DataFrame) -> DataFrame:
    """Route a table of JSON events and mark the ones that would be refused.

    Adds ``tool``, ``argument``, ``ok`` and ``error``. A key selects its tool
    even with a null value. Text that is not JSON selects none. ``tables`` holds
    each known ``table_name`` once.
    """
    document = F.col("document")
    tool = (
        F.when(document.isNull(), F.lit(None).cast("string"))
        .when(J.field(document, QUERY_KEY).isNotNull(), EXECUTE_SQL)
        .when(J.field(document, TABLE_KEY).isNotNull(), DESCRIBE_TABLE)
        .otherwise(LIST_TABLES)
    )
    argument = (
        F.when(F.col("tool") == EXECUTE_SQL, J.text_of(J.field(document, QUERY_KEY)))
        .when(F.col("tool") == DESCRIBE_TABLE, J.text_of(J.field(document, TABLE_KEY)))
    )
    known = tables.select(F.col("table_name").alias("known_table"))
    error = (
        F.when(F.col("document").isNull(), NOT_AN_EVENT)
        .when(F.col("tool") == EXECUTE_SQL, _query_problem(F.col("argument")))
        .when(F.col("tool") == DESCRIBE_TABLE, _table_problem(F.col("argument"), F.col("known_table")))
    )
    parsed = events.withColumn("document", F.try_parse_json(F.col(body)))
    routed = parsed.withColumn("tool", tool).withColumn("argument", text.strip(argument))
    described = (F.col("tool") == DESCRIBE_TABLE) & (F.col("argument") == F.col("known_table"))
    return (
        routed.join(known, described, "left")
        .withColumn("error", error)
        .withColumn("ok", F.col("error").isNull())
        .drop("document", "known_table")
    )
