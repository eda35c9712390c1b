"""Queries along the order of events and the edges of a graph, by operators that bear hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.operators import graphs, intervals, quantiles, scans
from clearledger.plans.registry import query
from clearledger.sources.files import scan_table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return scan_table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", cents.alias("cents"))


@query(
    """
    SELECT event_id, user_id, lag(event_id) OVER w AS previous_event, lead(event_id, 2) OVER w AS next_but_one,
           CAST(sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cents,
           CAST(sum(cents) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near_cents
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """
)
def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours and running sums of each user's events, whatever share of them a user has."""
    rows = scans.framed(
        _events(spark, folder), ["user_id"], ["ts", "event_id"],
        {
            "previous_event": lambda w: F.lag("event_id").over(w),
            "next_but_one": lambda w: F.lead("event_id", 2).over(w),
            "near_cents": lambda w: F.sum("cents").over(w.rowsBetween(-1, 1)),
        },
        before=1, after=2, totals={"running_cents": F.col("cents")},
    )
    return rows.select("event_id", "user_id", "previous_event", "next_but_one", "running_cents", "near_cents")


@query(
    """
    SELECT e.event_id, e.user_id, CASE WHEN p.ts >= e.ts - INTERVAL 12 HOURS THEN p.event_id END AS purchase_id
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
    """
)
def purchase_before_error(spark: SparkSession, folder: str) -> DataFrame:
    """Each error with the user's latest purchase of the twelve hours before it."""
    events = _events(spark, folder)
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    met = scans.asof_join(errors, bought, ["user_id"], "ts", "ts", ["purchase_id"], F.expr("INTERVAL 12 HOURS"))
    return met.select("event_id", "user_id", "match.purchase_id")


# How long an alarm lasts depends on its event: minutes for most, days for some, without end for a few.
ALARMS = """
    SELECT event_id AS alarm_id, user_id % 7 AS team, ts AS opened,
           CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 41 = 0 THEN ts + INTERVAL 3 DAYS
                WHEN event_id % 5 = 0 THEN ts ELSE ts + INTERVAL 20 MINUTES END AS closed
    FROM events WHERE event_type = 'error' AND event_id % 3 = 0
"""


@query(
    f"""
    SELECT a.alarm_id, count(*) AS n_events, min(e.event_id) AS first_event
    FROM ({ALARMS}) a JOIN events e
      ON e.user_id % 7 = a.team AND e.ts >= a.opened AND (a.closed IS NULL OR e.ts < a.closed)
    GROUP BY a.alarm_id
    """
)
def events_in_alarms(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a team that fall into each of its alarms."""
    events = scan_table(spark, folder, "events")
    events.createOrReplaceTempView("__events_in_alarms")
    alarms = spark.sql(ALARMS.replace("FROM events", "FROM __events_in_alarms"))
    teams = events.select("event_id", "ts", (F.col("user_id") % 7).alias("team"))
    met = intervals.points_within(teams, alarms, "ts", ("opened", "closed"), ["team"])
    return met.groupBy(F.col("span.alarm_id").alias("alarm_id")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("point.event_id").alias("first_event")
    )


@query(
    f"""
    SELECT a.team, count(*) AS n_pairs, CAST(sum(a.alarm_id) AS BIGINT) AS first_sum, CAST(sum(b.alarm_id) AS BIGINT) AS second_sum
    FROM ({ALARMS}) a JOIN ({ALARMS}) b
      ON a.team = b.team AND a.alarm_id < b.alarm_id
     AND (a.closed IS NULL OR a.opened < a.closed) AND (b.closed IS NULL OR b.opened < b.closed)
     AND (b.closed IS NULL OR a.opened < b.closed) AND (a.closed IS NULL OR b.opened < a.closed)
    GROUP BY a.team
    """
)
def overlapping_alarms(spark: SparkSession, folder: str) -> DataFrame:
    """Per team the pairs of alarms that are open at the same time."""
    scan_table(spark, folder, "events").createOrReplaceTempView("__overlapping_alarms")
    alarms = spark.sql(ALARMS.replace("FROM events", "FROM __overlapping_alarms"))
    met = intervals.overlap_join(alarms, alarms, ("opened", "closed"), ("opened", "closed"), ["team"])
    pairs = met.where("left.alarm_id < right.alarm_id")
    return pairs.groupBy(F.col("left.team").alias("team")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("left.alarm_id").alias("first_sum"), F.sum("right.alarm_id").alias("second_sum")
    )


@query(
    """
    WITH RECURSIVE edges AS (
        SELECT DISTINCT a.l_suppkey AS one, b.l_suppkey AS other
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_partkey % 40 = b.l_partkey % 40
    ), paths(start, node, steps) AS (
        SELECT one, other, CAST(1 AS BIGINT) FROM edges WHERE one % 20 = 0
        UNION
        SELECT p.start, e.other, p.steps + 1 FROM paths p JOIN edges e ON p.node = e.one WHERE p.steps < 200
    )
    SELECT start, node, min(steps) AS steps FROM paths GROUP BY start, node
    """
)
def supplier_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers that lines of related parts, returned one after the other, link to every twentieth one."""
    returned = scan_table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    part = F.col("l_partkey") % 40
    ahead = returned.select("l_orderkey", part.alias("kind"), F.col("l_linenumber") + 1, F.col("l_suppkey").alias("one"))
    ahead = ahead.toDF("l_orderkey", "kind", "l_linenumber", "one")
    then = returned.select("l_orderkey", part.alias("kind"), "l_linenumber", F.col("l_suppkey").alias("other"))
    edges = ahead.join(then, ["l_orderkey", "kind", "l_linenumber"]).select("one", "other")
    return graphs.reachable(edges, "one", "other", F.col("one") % 20 == 0)


@query(
    """
    SELECT l_returnflag, fraction, count(*) AS n,
           CASE fraction WHEN 0.1 THEN quantile_cont(amount, 0.1) WHEN 0.5 THEN quantile_cont(amount, 0.5)
                WHEN 0.99 THEN quantile_cont(amount, 0.99) END AS percentile
    FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS amount FROM lineitem),
         (SELECT CAST(unnest([0.1, 0.5, 0.99]) AS DOUBLE) AS fraction)
    GROUP BY l_returnflag, fraction
    """
)
def amount_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the amounts of each kind of line, nearly all of which differ."""
    lines = scan_table(spark, folder, "lineitem")
    amounts = lines.select("l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    return quantiles.exact_percentiles(amounts, ["l_returnflag"], "amount", [0.1, 0.5, 0.99])
