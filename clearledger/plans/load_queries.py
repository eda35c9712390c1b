"""Queries on loading, typing and cleaning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.operators import typing as Y
from clearledger.operators.counts import table_counts
from clearledger.plans.load import load_table, load_tables
from clearledger.plans.registry import SCRATCH, TABLES, query
from clearledger.session import shared_folder
from clearledger.sources.files import scan, scan_table
from clearledger.sources.tables import ensure_database, quoted
from clearledger.specs import MaskPolicy, TableSpec
from clearledger.streaming import intake
from clearledger.streaming import sessions as S

WIDTHS = dict(zip(TABLES, (2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4), strict=True))


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {w} AS n_columns FROM {t}"
        for t, w in WIDTHS.items()
    )
)
def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table_counts({t: scan_table(spark, folder, t) for t in TABLES})


@query(
    """
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
    FROM customer
    """
)
def refresh_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "refresh")
    ensure_database(spark, SCRATCH, f"{root}/database")
    load_table(spark, TableSpec("customer"), folder, SCRATCH, root)
    return spark.table(quoted(SCRATCH, "customer"))


LOADED = ("supplier", "orders", "lineitem")
# Columns of a table as it may come: clocks, stamps and phones as text, some of it unreadable or escaped.
CONTACTS = {
    "c_custkey": "c_custkey",
    "clock": "CASE c_custkey % 4 WHEN 0 THEN '25:00' WHEN 1 THEN '' ELSE '12:34' END",
    "stamp": "CASE c_custkey % 3 WHEN 0 THEN 'soon' ELSE '2020-01-02 03:04:05' END",
    "note": "concat('a_x0020_', c_name)",
    "phone": "CASE c_custkey % 5 WHEN 0 THEN '+65 9' WHEN 1 THEN '' ELSE concat('9875 ', 1000 + c_custkey % 9000) END",
    "street": "CASE WHEN c_custkey % 6 > 0 THEN c_name END",
}
CONTACT_SPEC = TableSpec(
    "contact", time_columns=("clock", "absent"), timestamp_columns=("stamp", "c_custkey"), escaped_text_columns=("note",)
)
CONTACT_POLICY = MaskPolicy(phones=("phone",), redacted=("street",))


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{t}' AS table_name, count(*) AS n_rows, {WIDTHS[t]} AS n_columns,
               count(*) AS n_written, CAST(0 AS BIGINT) AS n_rejected,
               CAST(0 AS BIGINT) AS n_visited, CAST(0 AS BIGINT) AS n_masked, true AS complete
        FROM {t}
        """
        for t in LOADED
    )
    + """
        UNION ALL
        SELECT 'contact', count(*), 6, count(*),
               count(*) FILTER (c_custkey % 4 = 0) + count(*) FILTER (c_custkey % 3 = 0),
               count(*) FILTER (c_custkey % 5 <> 1) + count(*) FILTER (c_custkey % 6 > 0),
               count(*) FILTER (c_custkey % 5 > 1) + count(*) FILTER (c_custkey % 6 > 0), true
        FROM customer
        UNION ALL SELECT 'contact_text', count(*), 6, count(*), 0, 0, 0, true FROM customer
    """
)
def load_report(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "load")
    database = f"{SCRATCH}_load"
    ensure_database(spark, database, f"{root}/database")
    contacts = scan_table(spark, folder, "customer").select(*[F.expr(e).alias(n) for n, e in CONTACTS.items()])
    source = f"{root}/contacts.parquet"
    contacts.write.parquet(source)
    plain = load_tables(spark, folder, database, root, [TableSpec(t) for t in LOADED], {})
    specs = [replace(CONTACT_SPEC, source="contacts.parquet"), TableSpec("contact_text", "contacts.parquet")]
    own = load_tables(spark, root, database, root, specs, {"contact": CONTACT_POLICY})
    return plain.unionByName(own)


@query(
    """
    SELECT c_custkey, 'XXXXX' AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
           c_mktsegment
    FROM customer
    """
)
def stream_intake(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "intake")
    source, spec = f"{folder}/customer*.parquet", TableSpec("customer")
    raw = spark.read.parquet(source)
    stream = intake.clean_and_mask(
        intake.arriving(spark, source, raw.schema),
        spec,
        Y.resolve_types(raw, spec),
        MaskPolicy(redacted=("c_name",)),
    )
    intake.append_to(stream, f"{root}/table", f"{root}/progress").awaitTermination()
    return scan(spark, root, "table")


# Devices send an event minutes after it happened, some a day or more later, and a few have no time or a wrong clock.
# It arrives in one of three loads.
ARRIVALS = """
    SELECT event_id, user_id, value, CASE WHEN event_id % 331 = 0 THEN NULL ELSE ts END AS ts,
           CASE WHEN event_id % 83 = 0 THEN ts + INTERVAL 30 HOURS WHEN event_id % 271 = 0 THEN ts - INTERVAL 1 HOUR
                ELSE ts + INTERVAL 1 MINUTE * (event_id % 180) END AS arrived
    FROM events
"""
# Loads end at these moments; the last takes the rest.
LOAD_ENDS = ("2024-01-11", "2024-01-21")
SESSION_GAP, SESSION_DELAY = "40 minutes", "6 hours"


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    scan_table(spark, folder, "events").createOrReplaceTempView("__arriving_events")
    return spark.sql(ARRIVALS.replace("FROM events", "FROM __arriving_events"))


@query(
    f"""
    WITH timely AS (
        SELECT * FROM ({ARRIVALS}) WHERE arrived >= ts AND arrived <= ts + INTERVAL {SESSION_DELAY}
    ), marked AS (
        SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL {SESSION_GAP}, true) AS begins FROM timely
        WINDOW w AS (PARTITION BY user_id ORDER BY ts)
    ), numbered AS (
        SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked
    ), whole AS (
        SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL {SESSION_GAP} AS closed, count(*) AS n_events,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM numbered GROUP BY user_id, session
    )
    SELECT * FROM whole
    WHERE closed <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {SESSION_DELAY} FROM timely)
    """
)
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user that are over, taken from a stream in three runs of one query."""
    root = shared_folder(spark, "sessions")
    rows = _arrivals(spark, folder)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    load = F.when(F.col("arrived") < F.lit(LOAD_ENDS[0]).cast(rows.schema["arrived"].dataType), 0)
    load = load.when(F.col("arrived") < F.lit(LOAD_ENDS[1]).cast(rows.schema["arrived"].dataType), 1).otherwise(2)
    for n in range(len(LOAD_ENDS) + 1):
        rows.where(load == n).write.mode("append").parquet(f"{root}/arrived")
        stream = intake.arriving(spark, f"{root}/arrived", rows.schema, files_per_batch=1_000_000)
        found = S.sessions(stream, ["user_id"], "ts", "arrived", SESSION_GAP, SESSION_DELAY, [cents])
        S.take_sessions(found, f"{root}/over", f"{root}/progress").awaitTermination()
    return scan(spark, root, "over")


@query(
    f"""
    SELECT event_id, user_id, ts, arrived,
           CASE WHEN ts IS NULL OR arrived IS NULL THEN 'untimed' WHEN arrived < ts THEN 'ahead' ELSE 'late' END AS aside
    FROM ({ARRIVALS}) WHERE coalesce(arrived < ts OR arrived > ts + INTERVAL {SESSION_DELAY}, true)
    """
)
def stream_aside(spark: SparkSession, folder: str) -> DataFrame:
    """Events that came too late for their session, or with wrong times, kept beside the sessions."""
    root = shared_folder(spark, "aside")
    rows = _arrivals(spark, folder)
    rows.write.parquet(f"{root}/arrived")
    stream = intake.arriving(spark, f"{root}/arrived", rows.schema)
    aside = S.set_aside(stream, "ts", "arrived", SESSION_DELAY)
    intake.append_to(aside, f"{root}/aside", f"{root}/progress").awaitTermination()
    return scan(spark, root, "aside").select("event_id", "user_id", "ts", "arrived", "aside")


BLANKED = "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END"


@query(f"SELECT c_custkey, nullif({BLANKED}, '') AS c_name FROM customer")
def empty_to_null(spark: SparkSession, folder: str) -> DataFrame:
    blanked = scan_table(spark, folder, "customer").select(
        "c_custkey", F.expr(BLANKED).alias("c_name")
    )
    return Y.prepare(blanked, TableSpec("customer")).frame


def _duck_kind(name: str) -> str:
    kind = f"CASE WHEN bool_and({name} % 1 = 0) THEN 'BIGINT' ELSE 'DOUBLE PRECISION' END"
    return f"(SELECT {kind} FROM lineitem)"


@query(
    f"""
    SELECT * FROM (VALUES
        (1, 'l_orderkey', 'BIGINT'), (2, 'l_partkey', 'BIGINT'), (3, 'l_suppkey', 'BIGINT'),
        (4, 'l_linenumber', 'BIGINT'), (5, 'l_quantity', {_duck_kind('l_quantity')}),
        (6, 'l_extendedprice', {_duck_kind('l_extendedprice')}),
        (7, 'l_discount', {_duck_kind('l_discount')}), (8, 'l_tax', {_duck_kind('l_tax')}),
        (9, 'l_returnflag', 'TEXT'), (10, 'l_linestatus', 'TEXT'), (11, 'l_shipdate', 'TIMESTAMP')
    ) AS report(ordinal, column_name, storage_type)
    """
)
def type_report(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = scan_table(spark, folder, "lineitem")
    return Y.schema_report(spark, Y.resolve_types(lineitem, TableSpec("lineitem")))


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
           CAST(l_quantity AS BIGINT) AS l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus, l_shipdate
    FROM lineitem
    """
)
def narrowed_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return Y.prepare(scan_table(spark, folder, "lineitem"), TableSpec("lineitem")).frame


# The time strings the checks read: full, short, impossible, empty, or no time at all.
CLOCK_CASES = """
    CASE event_id % 6 WHEN 0 THEN {full} WHEN 1 THEN {short} WHEN 2 THEN '25' || substr({full}, 3)
    WHEN 3 THEN '' WHEN 4 THEN event_type ELSE {full} END
"""
SPARK_CLOCK = CLOCK_CASES.format(full="date_format(ts, 'HH:mm:ss')", short="date_format(ts, 'HH:mm')")
DUCK_CLOCK = CLOCK_CASES.format(full="strftime(ts, '%H:%M:%S')", short="strftime(ts, '%H:%M')")


def _clocks(spark: SparkSession, folder: str) -> DataFrame:
    events = scan_table(spark, folder, "events")
    return events.select("event_id", "ts", F.expr(SPARK_CLOCK).alias("clock"))


CLOCK_SPEC = TableSpec("events", time_columns=("clock",))


@query(
    f"""
    SELECT event_id, ts, CAST(TRY_CAST(clock AS TIME) AS VARCHAR) AS clock
    FROM (SELECT event_id, ts, {DUCK_CLOCK} AS clock FROM events)
    """
)
def time_of_day(spark: SparkSession, folder: str) -> DataFrame:
    return Y.prepare(_clocks(spark, folder), CLOCK_SPEC).frame


# The timestamp strings the checks read, with the far-future mark for "still open".
STAMP_CASES = """
    CASE o_orderkey % 7 WHEN 0 THEN '9999-12-31 00:00:00' WHEN 1 THEN 'junk'
    WHEN 2 THEN {day} WHEN 3 THEN '' WHEN 4 THEN {year} ELSE {day} || ' 07:08:09' END
"""
SPARK_STAMP = STAMP_CASES.format(
    day="date_format(o_orderdate, 'yyyy-MM-dd')", year="date_format(o_orderdate, 'yyyy')"
)
DUCK_STAMP = STAMP_CASES.format(
    day="strftime(o_orderdate, '%Y-%m-%d')", year="strftime(o_orderdate, '%Y')"
)
STAMP_SPEC = TableSpec("orders", timestamp_columns=("stamp",))


def _stamps(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan_table(spark, folder, "orders")
    return orders.select("o_orderkey", F.expr(SPARK_STAMP).alias("stamp"))


DUCK_PARSED = f"""
    SELECT o_orderkey, stamp,
           coalesce(try_strptime(stamp, '%Y-%m-%d %H:%M:%S'), try_strptime(stamp, '%Y-%m-%d')) AS parsed
    FROM (SELECT o_orderkey, {DUCK_STAMP} AS stamp FROM orders)
"""


@query(
    f"""
    SELECT o_orderkey, strftime(parsed, '%Y-%m-%d %H:%M:%S') AS stamp_text,
           coalesce(year(parsed) = 9999, false) AS is_open
    FROM ({DUCK_PARSED})
    """
)
def timestamp_strings(spark: SparkSession, folder: str) -> DataFrame:
    parsed = Y.prepare(_stamps(spark, folder), STAMP_SPEC).frame
    return parsed.select(
        "o_orderkey",
        F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp_text"),
        F.coalesce(F.year("stamp") == 9999, F.lit(False)).alias("is_open"),
    )


@query(
    f"""
    SELECT 'stamp' AS column_name, 'TIMESTAMP' AS storage_type,
           count(*) FILTER (WHERE stamp <> '' AND parsed IS NULL) AS n_rejected
    FROM ({DUCK_PARSED})
    """
)
def declared_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return Y.reject_counts(_stamps(spark, folder), STAMP_SPEC)


@query("SELECT p_partkey, replace(replace(p_name, ' ', '_x0020_'), '_x0020_', ' ') AS p_name FROM part")
def escaped_text(spark: SparkSession, folder: str) -> DataFrame:
    escaped = scan_table(spark, folder, "part").select(
        "p_partkey", F.replace("p_name", F.lit(" "), F.lit("_x0020_")).alias("p_name")
    )
    return Y.prepare(escaped, TableSpec("part", escaped_text_columns=("p_name",))).frame


@query(
    f"""
    WITH prepared AS (
        SELECT event_id, ts, CAST(TRY_CAST({DUCK_CLOCK} AS TIME) AS VARCHAR) AS clock FROM events
    )
    SELECT 'ts' AS column_name, 'TIMESTAMP' AS storage_type,
           CAST(arg_min(ts, event_id) AS VARCHAR) AS sample, 3 AS n_moment_columns
    FROM prepared
    UNION ALL
    SELECT 'clock', 'TIME', arg_min(clock, event_id) FILTER (WHERE clock IS NOT NULL), 3 FROM prepared
    UNION ALL
    SELECT 'closed', 'TIME', 'all null', 3
    """
)
def first_samples(spark: SparkSession, folder: str) -> DataFrame:
    raw = _clocks(spark, folder).withColumn("closed", F.lit(""))
    prepared = Y.prepare(raw, TableSpec("events", time_columns=("clock", "closed")))
    return Y.first_samples(prepared.frame, prepared.types, order_key="event_id")
