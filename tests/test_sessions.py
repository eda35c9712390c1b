"""Sessions of a stream against sessions worked out by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clearledger.streaming import intake
from clearledger.streaming import sessions as S

SCHEMA = "who string, ts timestamp_ntz, arrived timestamp_ntz, cents long"
GAP, DELAY = timedelta(minutes=30), timedelta(hours=2)
START = datetime(2024, 3, 30, 22)


def expected(rows):
    """Sessions of the rows in time, and the reasons of the others."""
    aside, times = [], {}
    for who, ts, arrived, cents in rows:
        if ts is None or arrived is None:
            aside.append("untimed")
        elif arrived < ts:
            aside.append("ahead")
        elif arrived > ts + DELAY:
            aside.append("late")
        else:
            times.setdefault(who, []).append((ts, cents))
    found = []
    for who, seen in times.items():
        seen.sort()
        session = [seen[0]]
        for event in seen[1:] + [None]:
            if event is None or event[0] > session[-1][0] + GAP:
                found.append((who, session[0][0], session[-1][0] + GAP, len(session), sum(c for _, c in session)))
                session = []
            if event:
                session.append(event)
    newest = max((t for seen in times.values() for t, _ in seen), default=START)
    return found, aside, newest - DELAY


def generated(seed, n=600):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        ts = START + timedelta(seconds=pick.randrange(0, 72 * 3600))
        wait = timedelta(minutes=pick.choice([0, 0, 5, 100, 120, 121, 600, -1]))
        who = "hot" if i % 3 == 0 else pick.choice(["a", "b", None])
        rows.append((who, None if i % 41 == 0 else ts, ts + wait if i % 59 else None, i))
    return rows


def found_in(frame):
    figures = frame.select("who", "opened", "closed", "n_events", "cents").collect()
    return sorted((tuple(r) for r in figures), key=str)


def grouped(rows):
    return S.sessions(rows, ["who"], "ts", "arrived", "30 minutes", "2 hours", [F.sum("cents").alias("cents")])


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_runs_of_a_stream(spark, tmp_path, zone):
    """The clocks of Berlin skip an hour in this time; zoneless times don't."""
    rows = generated(1)
    whole, aside, over = expected(rows)
    place = str(tmp_path)
    arrivals = sorted(rows, key=lambda r: r[2] or START)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        counts, closed = [], []
        for part in (arrivals[:150], arrivals[150:400], arrivals[400:]):
            spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{place}/in")
            stream = intake.arriving(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema)
            run = S.take_sessions(grouped(stream), f"{place}/over", f"{place}/progress")
            run.awaitTermination()
            dropped = [o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"]]
            closed.append(spark.read.parquet(f"{place}/over").count())
            counts.append(sum(dropped))
        assert counts == [0, 0, 0]
        # The nodes are printed from the last to the first: sessions are merged on both sides of the shuffle.
        plan = run._jsq.explainInternal(False)
        assert plan.index("MergingSessions") < plan.index("Exchange") < plan.rindex("MergingSessions")
        assert 0 < closed[0] < closed[1] < closed[2]
        wanted = [s for s in whole if s[2] <= over]
        assert found_in(spark.read.parquet(f"{place}/over")) == sorted(wanted, key=str)
        assert len(wanted) < len(whole)
        kept = S.set_aside(spark.read.parquet(f"{place}/in"), "ts", "arrived", "2 hours")
        assert sorted(r["aside"] for r in kept.collect()) == sorted(aside)
        assert {"late", "ahead", "untimed"} == set(aside)
        # On a table nothing stays open, and no row is lost between sessions and those set aside.
        table = found_in(grouped(spark.read.parquet(f"{place}/in")))
        assert table == sorted(whole, key=str)
        assert sum(r[3] for r in table) + len(aside) == len(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_events_a_gap_apart_and_repeated_events(spark):
    at = [START, START, START + GAP - timedelta(microseconds=1), START + 2 * GAP, START + 3 * GAP, START + 4 * GAP + timedelta(microseconds=1)]
    rows = spark.createDataFrame([("a", t, t, 1) for t in at], SCHEMA)
    got = found_in(grouped(rows))
    assert [(r[1], r[3]) for r in got] == [(START, 3), (START + 2 * GAP, 2), (at[-1], 1)]


def test_empty_table_and_moments(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert grouped(none).count() == 0
    assert S.set_aside(none, "ts", "arrived", "2 hours").count() == 0
    moments = none.withColumn("ts", F.col("ts").cast("timestamp"))
    assert dict(grouped(moments).dtypes)["closed"] == "timestamp"
    assert dict(grouped(none).dtypes)["closed"] == "timestamp_ntz"
