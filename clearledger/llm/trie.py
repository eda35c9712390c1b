"""The trie of all prefixes of conversations, with totals of every subtree, by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearledger.llm.common import columns_of, stored

# Words of 32 bits in a prefix's name, and the name of the empty prefix.
WORDS = 4
ROOT = bytes(4 * WORDS)
# Messages that a queue holds in memory, rows of a batch that leaves a task, bytes of ids hashed at a time.
HELD, BATCH, CHUNK = 200_000, 10_000, 1 << 18
# Shard roots that one task takes on; more are dealt to shards of their own.
SMALL = 50_000
# Code points of a text by which ranges of equal turns can be divided.
LEADING = 32


class SpillingQueue:
    """A priority queue of tuples. Beyond ``held`` of them the queue writes a sorted run to the task's scratch files.

    These lie where the executor keeps its own spills, without a name, and are gone when the queue is.
    """

    def __init__(self, held: int = HELD) -> None:
        self.held, self.heap, self.runs, self.heads = held, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)  # noqa: SIM115
        for begin in range(0, len(self.heap), BATCH):
            pickle.dump(self.heap[begin : begin + BATCH], file)
        file.seek(0)
        self.heap = []
        run = self._read(file)
        self.runs.append(run)
        heapq.heappush(self.heads, (next(run), len(self.runs) - 1))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    part = pickle.load(file)
                except EOFError:
                    return
                yield from part

    def head(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = self.heads[0]
            following = next(self.runs[run], None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, run))
            return item
        return heapq.heappop(self.heap)


def ordered_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, part, pos, total, content, chars``: each turn's place in its conversation and what it says, as a hash.

    Turns are in the order of their number, NULL first, then role and text; NULL roles and texts are empty. Rows are dealt by ranges of that
    order and numbered within them; a small table of where a conversation begins in each range makes these numbers places, so that a
    conversation of a third of all rows is as spread as any. Rows without a conversation belong to none.
    """
    rows = columns_of(turns, conv=conv, turn=turn, role=role, text=text).where("conv IS NOT NULL")
    rows = rows.select(
        F.col("conv").cast("long").alias("conv"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    )
    ranged = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, LEADING))
    said = F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text"))
    numbered = stored(
        ranged.sortWithinPartitions("conv", "turn", "role", "text").select(
            "conv", F.monotonically_increasing_id().alias("seq"), F.sha2(said, 256).alias("content"),
            F.length("text").cast("long").alias("chars"), F.spark_partition_id().alias("part"),
        ),
        "trie-turns",
    )
    spans = numbered.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "conv", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("zero"),
        F.sum("n").over(own).alias("total"),
    )
    return numbered.join(spans, ["conv", "part"]).select(
        "conv", "part", (F.col("seq") - F.col("zero")).alias("pos"), "total", "content", "chars"
    )


def shared_heads(ordered: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``head`` turns of conversation ``base`` and go on with their own after so many.

    ``base`` and ``head``, at most ``most``, are of the column ``conv``. Given ``ordered_turns``, returns turns of the same kind and
    ``conv, total`` of all conversations, among them those that are left without turns.
    """
    ordered = stored(ordered, "trie-ordered")
    convs = ordered.where("pos = 1").select("conv", "total", base.alias("base"), head.alias("head"))
    heads = ordered.where(F.col("pos") <= most).select(
        F.col("conv").alias("base"), F.col("pos"), F.col("content"), F.col("chars"), F.col("total").alias("base_total")
    )
    lengths = heads.where("pos = 1").select("base", "base_total")
    taken = F.least(F.col("head"), F.coalesce(F.col("base_total"), F.lit(0)))
    convs = convs.join(lengths, "base", "left").select(
        "conv", "base", taken.alias("taken"), "head", (taken + F.greatest(F.col("total") - F.col("head"), F.lit(0))).alias("total")
    )
    convs = stored(convs, "trie-conversations")
    begun = convs.join(heads, "base").where("pos <= taken").select("conv", "pos", "total", "content", "chars")
    # Joined by conversation and range, so that no conversation is one task.
    parts = ordered.select("conv", "part").distinct().join(convs, "conv")
    rest = ordered.drop("total").join(parts, ["conv", "part"]).where("pos > head").select(
        "conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "total", "content", "chars"
    )
    return begun.unionByName(rest), convs.select("conv", "total")


def _named(turns: DataFrame) -> DataFrame:
    """Add ``key`` and ``parent``, the names of the prefixes that end with each turn and before it.

    A prefix's name is the sum of 128 bits of its turns' SHA-256, each taken with the turn's place, word by word. Sums of ranges are
    added up first and carried into each range.
    """
    words = [f"w{i}" for i in range(WORDS)]
    digest = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), F.col("content")), 256)
    rows = turns.withColumn("digest", digest).select(
        "conv", "pos", "total", "chars",
        *(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(words)),
    )
    ranged = stored(rows.repartitionByRange("conv", "pos").withColumn("part", F.spark_partition_id()), "trie-words")
    sums = ranged.groupBy("conv", "part").agg(*(F.sum(w).alias(w) for w in words))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv", "part", *(F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_offset") for w in words))
    within = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(offsets, ["conv", "part"]).withColumns(
        {f"{w}_sum": F.col(f"{w}_offset") + F.sum(w).over(within) for w in words}
    )

    def name(*parts: Column) -> Column:
        low = [F.lpad(F.hex(p.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for p in parts]
        return F.unhex(F.concat(*low))

    return summed.select(
        "conv", "pos", "total", "chars",
        name(*(F.col(f"{w}_sum") for w in words)).alias("key"),
        name(*(F.col(f"{w}_sum") - F.col(w) for w in words)).alias("parent"),
    )


def _in_shards(work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str):
    """mapInPandas over rows sorted by shard and then as ``work`` needs them: what it makes of each shard."""
    names = [column.split()[0] for column in schema.split(", ")]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(*(b[c].tolist() for c in b.columns), strict=True))
        out = []
        for _, own in groupby(rows, key=itemgetter(0)):
            for row in work(own):
                out.append(row)
                if len(out) == BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return made


# A node of a shard, or (``node`` false) what other shards send to ``key``.
NODE = "shard int, node boolean, depth long, key binary, up long, parent binary, conv long, n long, leaves long, saved long"
COLUMNS = [column.split()[0] for column in NODE.split(", ")]
MAIL = "shard int, depth long, key binary, leaves long, saved long, children long"
TOTALS = "depth long, key binary, conv long, n long, parent_conv long, leaves long, saved long, children long"
TOPS = "top binary, top_depth long, top_parent binary, top_up long, top_conv long"
PLACED = f"{NODE}, parent_conv long, {TOPS}"


def _upwards(whole: bool):
    """Reverse level order: each node adds what its children sent to its own figures and sends the sum to its parent.

    What is left for a parent that isn't in the shard is returned, added up for each such parent; or, with ``whole``, the
    totals of all nodes are, which are then final.
    """

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        queue = SpillingQueue()
        shard = 0

        def missed(until: tuple | None) -> Iterator[tuple]:
            """Messages to parents that would have come before ``until``."""
            while (head := queue.head()) is not None and (until is None or head[:2] < until):
                sums = [0, 0, 0]
                while (same := queue.head()) is not None and same[:2] == head[:2]:
                    sums = [a + b for a, b in zip(sums, queue.pop()[2:], strict=True)]
                if not whole:
                    yield (shard, -head[0], head[1], *sums)

        for shard, node, depth, key, up, parent, conv, n, leaves, saved, parent_conv, children in rows:
            here = (-depth, key)
            yield from missed(here)
            if not node:
                queue.push((*here, leaves, saved, children))
                continue
            children = 0
            while (head := queue.head()) is not None and head[:2] == here:
                _, _, more, also, ones = queue.pop()
                leaves, saved, children = leaves + more, saved + also, children + ones
            if whole:
                yield depth, key, conv, n, parent_conv, leaves, saved, children
            queue.push((-up, parent, leaves, saved, 1))
        yield from missed(None)

    return work


def _downwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Level order: each node learns its parent's conversation and the root of its tree within the shard.

    Parents of other shards stand among the rows with their conversation; a node below one of them is a root.
    """
    queue = SpillingQueue()
    for row in rows:
        _, node, depth, key, up, parent, conv, *_ = row
        here = (up, parent)
        while (head := queue.head()) is not None and head[:2] < here:
            queue.pop()
        if not node:
            queue.push((*here, conv, b""))
            continue
        known = head is not None and head[:2] == here
        top = head[3:] if known and head[3] else (key, depth, parent, up, conv)
        yield (*row, head[2] if known else 0, *top)
        queue.push((depth, key, conv, *top))


def subtree_totals(nodes: DataFrame, shards: int | None = None) -> DataFrame:
    """``depth, key, conv, n, parent_conv, leaves, saved, children`` of all ``nodes``, a forest below ROOT.

    Nodes have ``depth, key, up, parent, conv, n, leaves, saved``; ``up`` is the parent's depth. ``leaves`` and ``saved`` become
    sums over subtrees. Ranges of conversations are shards, so these are of one size whatever the tree's shape; a parent
    often is in the shard of its children. Each shard is sorted by Spark and gone through once in reverse
    level order. The sums that leave a shard are added up for each receiving node. Where such a node has
    a shard root above it that must pass the sums on, the shard roots form a smaller forest, whose totals are found in the same way;
    then each shard, sorted again, takes in what others sent.
    """
    if shards:
        dealt = nodes.repartitionByRange(shards, "conv", "depth", "key").withColumn("shard", F.spark_partition_id())
    elif nodes.count() <= SMALL:
        dealt = nodes.withColumn("shard", F.lit(0))
    else:
        dealt = nodes.repartitionByRange("conv", "depth", "key").withColumn("shard", F.spark_partition_id())
    dealt = stored(dealt.withColumn("node", F.lit(True)).select(*COLUMNS), "trie-nodes")
    nothing = {"parent_conv": F.lit(0).cast("long"), "children": F.lit(0).cast("long")}
    upward = ("shard", F.desc("depth"), "key", "node")
    mail = stored(
        dealt.withColumns(nothing).repartition("shard").sortWithinPartitions(*upward)
        .mapInPandas(_in_shards(_upwards(False), MAIL), MAIL),
        "trie-mail",
    ).where("depth > 0")

    def as_rows(sent: DataFrame, **given: str) -> DataFrame:
        """Messages as rows that go through a shard with its nodes."""
        empty = {"node": "false", "conv": "0L", "n": "0L", "leaves": "0L", "saved": "0L", "up": "0L", "depth": "0L",
                 "key": "X''", "parent": "X''", "parent_conv": "0L", "children": "0L"}
        return sent.selectExpr("shard", *(f"{e} AS {c}" for c, e in {**empty, **given}.items()))

    senders = mail.select("shard", "depth", "key").join(dealt.select("key", "conv"), "key")
    parents = as_rows(senders, up="depth", parent="key", conv="conv").select(*COLUMNS)
    placed = stored(
        dealt.unionByName(parents).repartition("shard").sortWithinPartitions("shard", "up", "parent", "node")
        .mapInPandas(_in_shards(_downwards, PLACED), PLACED),
        "trie-placed",
    )
    sums = ("leaves", "saved", "children")
    tops = [column.split()[0] for column in TOPS.split(", ")]
    received = mail.groupBy("key").agg(*(F.sum(c).alias(c) for c in sums))
    received = stored(received.join(placed.select("key", "depth", "shard", *tops), "key"), "trie-received")
    inputs = received.select("shard", "depth", "key", *sums)
    passed = received.where("top_up > 0")
    if not passed.isEmpty():
        # Shard roots that got something from outside and have a parent to tell.
        roots = received.groupBy(*tops).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        above = received.select(F.col("key").alias("top_parent"), F.col("top").alias("parent"), F.col("top_depth").alias("up"))
        forest = stored(roots.join(above, "top_parent", "left"), "trie-roots")
        totals = subtree_totals(
            forest.select(
                F.col("top_depth").alias("depth"), F.col("top").alias("key"), F.coalesce("up", F.lit(0)).alias("up"),
                F.coalesce("parent", F.lit(ROOT)).alias("parent"), F.col("top_conv").alias("conv"),
                F.lit(0).cast("long").alias("n"), "leaves", "saved",
            ),
            shards=shards if shards and forest.count() > SMALL else None,
        )
        told = totals.select(F.col("key").alias("top"), "leaves", "saved").join(forest.select("top", "top_parent"), "top")
        told = told.groupBy(F.col("top_parent").alias("key")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.lit(0).cast("long").alias("children")
        )
        inputs = inputs.unionByName(told.join(received.select("key", "depth", "shard"), "key").select(*inputs.columns))
    sent = as_rows(inputs, depth="depth", key="key", leaves="leaves", saved="saved", children="children")
    columns = [*COLUMNS, "parent_conv", "children"]
    all_rows = placed.withColumn("children", F.lit(0).cast("long")).select(*columns).unionByName(sent.select(*columns))
    return stored(
        all_rows.repartition("shard").sortWithinPartitions(*upward).mapInPandas(_in_shards(_upwards(True), TOTALS), TOTALS),
        "trie-totals",
    )


def _listed(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the hash of the ascending, comma-joined ``conv`` of each key, however many these are.

    Ranges of the order are joined to texts of bounded size, and only these meet in the task that hashes a key's.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(b["key"].tolist(), b["conv"].tolist(), strict=True))
        out: list[tuple] = []
        for key, own in groupby(rows, key=itemgetter(0)):
            first, parts, size = None, [], 0
            for _, conv in own:
                first = conv if first is None else first
                parts.append(str(conv))
                size += len(parts[-1]) + 1
                if size > CHUNK:
                    yield pd.DataFrame([(key, first, ",".join(parts))], columns=["key", "first", "ids"])
                    first, parts, size = None, [], 0
            if parts:
                out.append((key, first, ",".join(parts)))
            if len(out) >= BATCH:
                yield pd.DataFrame(out, columns=["key", "first", "ids"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(b["key"].tolist(), b["ids"].tolist(), strict=True))
        out: list[tuple] = []
        for key, own in groupby(rows, key=itemgetter(0)):
            digest = hashlib.sha256(next(own)[1].encode())
            for _, ids in own:
                digest.update(b"," + ids.encode())
            out.append((key, digest.hexdigest()))
            if len(out) >= BATCH:
                yield pd.DataFrame(out, columns=["key", "ends_sha256"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])

    ranged = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    joined = ranged.mapInPandas(texts, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInPandas(hashed, "key binary, ends_sha256 string")


def build(turns: DataFrame, convs: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie's nodes of ``turns`` as ``ordered_turns`` gives them, and ``conv, total`` of all conversations."""
    named = stored(_named(turns), "trie-named")
    ends = named.where("pos = total").select("key", "conv").unionByName(
        convs.where("total = 0").select(F.lit(ROOT).alias("key"), "conv")
    )
    distinct = named.groupBy("key", "parent", F.col("pos").alias("depth"), "chars").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == F.col("total")).alias("n_ends")
    )
    nodes = distinct.select(
        "depth", "key", (F.col("depth") - 1).alias("up"), "parent", "conv", "n",
        (F.col("n_ends") == F.col("n")).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("chars")).alias("saved"),
    )
    totals = subtree_totals(stored(nodes, "trie-distinct"), shards)
    about = convs.agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")).first()
    long = F.lit(None).cast("long")
    root = totals.where("depth = 1").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("leaves", "saved")), F.count(F.lit(1)).alias("children")
    ).where(F.lit(about["n"] > 0)).select(
        F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(about["least"]).cast("long").alias("conv"),
        F.lit(about["n"]).cast("long").alias("n"), long.alias("parent_conv"),
        F.greatest("leaves", F.lit(1)).alias("leaves"), "saved", "children",
    )
    inner = totals.withColumn(
        "parent_conv", F.when(F.col("depth") == 1, F.lit(about["least"]).cast("long")).otherwise(F.col("parent_conv"))
    )
    listed = inner.unionByName(root).join(_listed(ends), "key", "left")
    return listed.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "key",
    )


def prefix_trie(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key`` of each distinct prefix.

    A node is a distinct sequence of first turns (role and text), the empty one, depth 0, included. conv_id is the smallest conversation that
    begins with it, n_convs how many do; n_leaves counts the childless nodes of its subtree; saved_tokens adds up, over the subtree,
    the code points of a node's last text for each conversation but one that shares it; ends_sha256 hashes
    the ids of the conversations that end there. ``key`` names the prefix by 128 bits of hash.

    Turns are ordered by number (NULL first), role and text; rows that tie in all three are equal, so their order is all one, and repeated
    rows are turns of their own. NULL roles and texts are empty. Rows with a NULL conversation belong to none and give no
    node. An empty table has no conversation and no node, not even a root. Texts of any length are read
    whole, as hash and length. Columns not named are not read.
    """
    ordered = stored(ordered_turns(turns, conv, turn, role, text), "trie-ordered")
    return build(ordered.drop("part"), ordered.where("pos = 1").select("conv", "total"), shards)
