"""What is reachable in a graph kept as a table of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearledger.operators.typing import column
from clearledger.sources.steps import written

# Rounds whose tables are read one by one before they become one.
PARTS = 8


def reachable(edges: DataFrame, source: str, target: str, starts: Column | None = None) -> DataFrame:
    """``start, node, steps``: each node that a path of one step or more leads to, with the steps of the shortest.

    ``starts`` is a condition on the edges' source that says where paths begin; without it they begin anywhere, and the
    result is the closure of the graph. Each round follows the edges from the pairs that the round before found for the first time and
    keeps what no round has found yet, written before the next begins; cycles end so by themselves. There are as many
    rounds as the longest shortest path has steps. Edges with a NULL end lead nowhere, repeated ones count once.
    """
    ends = [column(source), column(target)]
    links = edges.where(ends[0].isNotNull() & ends[1].isNotNull())
    known = links.select(ends[0].alias("__from"), ends[1].alias("__to")).distinct()
    begun = (links if starts is None else links.where(starts)).select(
        ends[0].alias("start"), ends[1].alias("node"), F.lit(1).cast("long").alias("steps")
    )
    known, new = written(known, "edges"), written(begun.distinct(), "reached")
    found, steps = [], 1
    while not new.isEmpty():
        found.append(new)
        if len(found) > PARTS:
            found = [written(reduce(DataFrame.unionByName, found), "reached")]
        steps += 1
        every = reduce(DataFrame.unionByName, found)
        further = new.join(known, new["node"] == known["__from"]).select("start", F.col("__to").alias("node")).distinct()
        fresh = further.join(every.select("start", "node"), ["start", "node"], "left_anti")
        new = written(fresh.withColumn("steps", F.lit(steps).cast("long")), "reached")
    return reduce(DataFrame.unionByName, found) if found else new
