from __future__ import annotations

import random
from collections import defaultdict

import brute
import pytest
from comparing import differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearledger.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_of(conversations):
    """Brute force over {conv_id: [(role, text)]}: the rows of the trie."""
    members = defaultdict(list)
    for conv in sorted(conversations):
        turns = tuple(conversations[conv])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    rows = {}
    for node in sorted(members, key=len, reverse=True):
        below = [child for child in rows if len(child) == len(node) + 1 and child[:-1] == node]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        rows[node] = (
            sum(rows[c][0] for c in below) or 1, own + sum(rows[c][1] for c in below), len(below),
            ",".join(str(c) for c in members[node] if len(conversations[c]) == len(node)),
        )
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), kids, leaves, saved, brute.sha(ends))
        for n, (leaves, saved, kids, ends) in rows.items()
    )


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def conversations_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[conv].append((role or "", text or ""))
    return out


def test_query_equals_sql(spark, folder):
    df = queries.QUERIES["op11_prefix_trie"](spark, folder)
    assert differences(df, queries.ORACLES["op11_prefix_trie"], folder) == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.none()), max_size=200), st.integers(1, 8))
def test_queue_spills_in_order(steps, held):
    """Numbers are pushed and None pops; what comes out is always the least."""
    queue, inside = trie.SpillingQueue(held), []
    for step in steps:
        if step is not None:
            queue.push((step, b"x"))
            inside.append((step, b"x"))
        elif inside:
            assert queue.head() == min(inside) == queue.pop()
            inside.remove(min(inside))
    assert [queue.pop() for _ in inside] == sorted(inside) and queue.head() is None


def random_rows(seed, n=60):
    """Long chains, a first turn of most conversations, copies of whole conversations, and wide nodes."""
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        if conv % 7 == 3:  # a copy of the conversation before
            rows += [(conv, t, r, x) for c, t, r, x in rows if c == conv - 1]
            continue
        turns = ["hot"] if pick.random() < 0.6 else [f"first {pick.randrange(4)}"]
        turns += [f"say {pick.randrange(2)}" for _ in range(pick.choice((0, 1, 2, 3, 6)))]
        if conv == 17:
            turns += [f"chain {i}" for i in range(150)]
        if conv % 3 == 1:
            turns += [f"own {conv}"]
        rows += [(conv * 3, i * 2, ("user", "assistant")[i % 2], t * (1 + len(t) % 3)) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("seed", "shards", "small"), [(1, 1, 50_000), (2, 7, 50_000), (3, 23, 4), (4, 40, 1)])
def test_sharded_totals(spark, monkeypatch, seed, shards, small):
    """However nodes are dealt to shards, and shard roots to further ones, the totals are the same."""
    monkeypatch.setattr(trie, "SMALL", small)
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.prefix_trie(df, shards=shards)) == nodes_of(conversations_of(rows))


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in (0, 1, 2, 3, 101, 205, 250, 299, 305, 1000, 1001)
            for t in range(min(c % 6 + 1, 5))]
    ordered = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    base = F.col("conv") - F.col("conv") % 100
    turns, convs = trie.shared_heads(ordered, base, F.col("conv") % 6, most=5)
    given_turns, want = conversations_of(rows), {}
    for conv, own in given_turns.items():
        want[conv] = given_turns.get(conv - conv % 100, [])[: conv % 6] + own[conv % 6 :]
    assert [] in want.values()  # one is left without turns
    assert {r["conv"]: r["total"] for r in convs.collect()} == {c: len(t) for c, t in want.items()}
    assert found(trie.build(turns, convs, shards=5)) == nodes_of(want)


def test_many_ends_of_one_node(spark, monkeypatch):
    rows = [(c, 0, "user", "the same") for c in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = nodes_of(conversations_of(rows))
    assert found(trie.prefix_trie(df)) == want
    monkeypatch.setattr(trie, "CHUNK", 100)
    assert found(trie.prefix_trie(df)) == want


EDGES = [
    (1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (1, 3, "user", "é中😀 "), (2, None, "user", ""), (2, 1, "", "x"),
    (None, 0, "user", "lost"), (None, None, None, None), (3, 5, "user", "b"), (3, 5, "assistant", "a"), (3, 5, "user", "a"),
    (4, 0, "user", "long " * 60_000), (5, 0, "user", "long " * 60_000), (5, 0, "userlong ", "long " * 59_999), (-7, 0, "a", "bc"), (-8, 0, "ab", "c"),
]


@pytest.mark.parametrize("shards", [None, 3])
def test_edges(spark, shards):
    df = spark.createDataFrame(EDGES, SCHEMA)
    want = nodes_of(conversations_of(EDGES))
    assert found(trie.prefix_trie(df, shards=shards)) == want
    clashing = df.select("turn", F.col("conv_id").alias("a conv"), "role", F.col("text").alias("key"),
                         *(F.lit("own").alias(n) for n in ("part", "pos", "conv", "text", "shard", "parent")))
    assert found(trie.prefix_trie(clashing, conv="a conv", text="key", shards=shards)) == want
    assert trie.prefix_trie(df.where("false"), shards=shards).count() == 0
    assert trie.prefix_trie(df.where("conv_id IS NULL"), shards=shards).count() == 0
