"""What a query would cost, read from its plan before it runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Fixed beginning of the message of a refused query.
TOO_COSTLY = "Query is too costly: "


@dataclass(frozen=True)
class Limits:
    """``scan_bytes`` of all tables together, where given, and of the smaller side of a join that compares every two rows."""

    scan_bytes: int | None = None
    loop_bytes: int = 10 * 1024 * 1024


@dataclass(frozen=True)
class Cost:
    """Bytes of the files read after pruning of partitions, and of the smaller side of each join without equal keys."""

    scan_bytes: int
    loop_bytes: tuple[int, ...]


def _nodes(plan) -> list:
    """The plan's nodes, those of subqueries included."""
    out, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        out.append(node)
        for held in (node.children(), node.subqueries()):
            waiting.extend(held.apply(i) for i in range(held.size()))
    return out


def _size(node) -> int:
    return int(str(node.stats().sizeInBytes()))


def estimated(df: DataFrame) -> Cost:
    """Sizes as the optimiser states them. Nothing runs.

    Filters are not counted on: a size is what a step may at most have to read, so an estimate is too high rather than too
    low. A side whose size the optimiser doesn't know counts as very large.
    """
    keys = df.sparkSession._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    scanned, loops = 0, []
    for node in _nodes(df._jdf.queryExecution().optimizedPlan()):
        if node.children().isEmpty():
            scanned += _size(node)
        elif node.nodeName() == "Join" and keys.unapply(node).isEmpty():
            sides = (_size(side) for side in (node.left(), node.right()))
            loops.append(min(sides))
    return Cost(scanned, tuple(loops))


def refuse_costly(df: DataFrame, limits: Limits) -> None:
    """Raise ValueError, with the reason, for a query beyond the limits."""
    cost = estimated(df)
    if limits.scan_bytes is not None and cost.scan_bytes > limits.scan_bytes:
        raise ValueError(f"{TOO_COSTLY}it reads {cost.scan_bytes} bytes, the limit is {limits.scan_bytes}")
    worst = max(cost.loop_bytes, default=0)
    if worst > limits.loop_bytes:
        raise ValueError(
            f"{TOO_COSTLY}a join without equal columns pairs all rows of tables of {worst} bytes and more, "
            f"the limit is {limits.loop_bytes}"
        )
