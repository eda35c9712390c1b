"""Read-only SQL over the registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearledger.functions.jsonvalues import rows_as_json
from clearledger.operators.costs import Limits, refuse_costly
from clearledger.session import session_conf

# Accepted beginnings and messages.
QUERY_STARTS = ("SELECT", "WITH")
QUERY_REQUIRED = "query is required"
ONLY_SELECT = "Only SELECT queries are allowed"
QUERY_FAILED = "Query failed: "

# Plan parts that run code outside Spark's own operators.
OUTSIDE_CODE = (
    '"class":"org.apache.spark.sql.catalyst.expressions.CallMethodViaReflection"',
    '"class":"org.apache.spark.sql.catalyst.plans.logical.ScriptTransformation"',
)

# Double quotes name columns (in ANSI mode only), errors are raised rather than
# turned into NULL, and tables cannot be reached by file path.
QUERY_SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
}


def checked_query(query: str | None, on_empty: str = QUERY_REQUIRED) -> str:
    """The query without a closing semicolon, if it begins like a query."""
    stripped = (query or "").strip()
    if not stripped:
        raise ValueError(on_empty)
    if not stripped.upper().startswith(QUERY_STARTS):
        raise ValueError(ONLY_SELECT)
    return stripped.removesuffix(";").rstrip()


def run_query(spark: SparkSession, query: str | None, limits: Limits | None = None) -> DataFrame:
    """Run one SELECT, and nothing else; with ``limits`` only one whose plan keeps them.

    A query may stand in a FROM clause while inserts, commands and statement
    lists may not, so Spark itself refuses those before anything runs. The
    analysed plan then shows whether the query would call a script or a
    method of the host.
    """
    text = checked_query(query)
    with session_conf(spark, QUERY_SETTINGS):
        probe = spark.sql(f"SELECT * FROM (\n{text}\n) LIMIT 0")
        plan = probe._jdf.queryExecution().analyzed().toJSON()
        if any(part in plan for part in OUTSIDE_CODE):
            raise ValueError(ONLY_SELECT)
        result = spark.sql(text)
        if limits:
            refuse_costly(result, limits)
        return result


def query_as_json(
    spark: SparkSession, query: str | None, stringify: bool = False, limits: Limits | None = None
) -> DataFrame:
    """Rows of a read-only query as JSON text, one object per row."""
    return rows_as_json(run_query(spark, query, limits), stringify)


def agent_query(spark: SparkSession, query: str | None, limits: Limits | None = None) -> tuple[DataFrame | None, str | None]:
    """JSON rows or the error text of a query that cannot be run.

    Errors in single rows are raised when they are computed; ``written_answer``
    in ``tool_events`` reports those too.
    """
    try:
        checked_query(query, on_empty=ONLY_SELECT)
        return query_as_json(spark, query, True, limits), None
    except ValueError as problem:
        return None, str(problem)
    except Exception as problem:
        return None, f"{QUERY_FAILED}{problem}"
