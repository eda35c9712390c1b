"""Sessions on a stream: events of a key that follow each other within a gap.

How late an event is shows in its own row, from when it happened and when it arrived. So what counts
as late doesn't hang on how the stream was cut into batches: rows that come too late are set aside by a
filter, and the engine, whose watermark trails the newest event in time, has none left to drop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clearledger.session import session_conf
from clearledger.streaming.intake import append_to

# Events of one task are merged to sessions before the shuffle, so a key with a large share of the events sends few rows.
MERGING = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
# A watermark needs moments. Times without a zone are read as UTC and given back without one, where no hour is missing or double.
ZONELESS = {"spark.sql.session.timeZone": "UTC"}
ASIDE = "aside"


def with_aside(events: DataFrame, happened: str, arrived: str, delay: str) -> DataFrame:
    """Adds ``aside``: why an event takes no part in sessions, or NULL if it does.

    ``untimed`` without either time; ``ahead`` if it arrived before it happened, by a wrong clock that would
    close everyone's sessions; ``late`` if more than ``delay`` passed between both.
    """
    happened_at, arrived_at = F.col(happened), F.col(arrived)
    reason = (
        F.when(happened_at.isNull() | arrived_at.isNull(), "untimed")
        .when(arrived_at < happened_at, "ahead")
        .when(arrived_at > happened_at + F.expr(f"INTERVAL {delay}"), "late")
    )
    return events.withColumn(ASIDE, reason)


def set_aside(events: DataFrame, happened: str, arrived: str, delay: str) -> DataFrame:
    """The events that take no part in sessions, whole, with the reason in ``aside``."""
    return with_aside(events, happened, arrived, delay).where(F.col(ASIDE).isNotNull())


def sessions(
    events: DataFrame, keys: Sequence[str], happened: str, arrived: str, gap: str, delay: str,
    figures: Sequence[Column] = (),
) -> DataFrame:
    """``keys, opened, closed, n_events`` and ``figures`` (named aggregates) of each session.

    A session goes on while the key's next event happens ``gap`` or less after the last one; ``closed``
    is ``gap`` after its last event. On a stream a session comes out once, when an event has happened
    ``delay`` or more after ``closed``; until then it stays in the state, one row per open session and key.
    On a table all sessions come out. A NULL key is a key.

    Files must arrive in the order of ``arrived``, batch by batch; within a batch any order will do. An event in time
    that comes in a later batch than one that arrived ``delay`` after it may be dropped, and the query's
    progress counts such rows (``numRowsDroppedByWatermark``).
    """
    timely = with_aside(events, happened, arrived, delay).where(F.col(ASIDE).isNull()).drop(ASIDE)
    kind = timely.schema[happened].dataType
    with session_conf(timely.sparkSession, ZONELESS):
        timely = timely.withColumn(happened, F.col(happened).cast("timestamp"))
        if timely.isStreaming:
            timely = timely.withWatermark(happened, delay)
        window = F.session_window(happened, gap).alias("__session")
        grouped = timely.groupBy(*keys, window).agg(F.count(F.lit(1)).alias("n_events"), *figures)
        others = [c for c in grouped.columns if c not in (*keys, "__session", "n_events")]
        opened, closed = F.col("__session.start").cast(kind), F.col("__session.end").cast(kind)
        return grouped.select(*keys, opened.alias("opened"), closed.alias("closed"), "n_events", *others)


def take_sessions(found: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the sessions that are over, exactly once per checkpoint, then stop.

    Run again with the same folders when more has arrived: open sessions go on.
    """
    with session_conf(found.sparkSession, MERGING):
        return append_to(found, folder, checkpoint)
