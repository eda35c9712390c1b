from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from clearledger.llm import queries, simhash


def expected(rows, radius=4):
    prints = [brute.simhash(text) for _, text in rows]
    root = brute.roots(prints, radius)
    least = {}
    for (key, _), value in zip(rows, prints, strict=True):
        if key is not None:
            least[root[value]] = min(key, least.get(root[value], key))
    return sorted(
        ((key, f"{value:016x}", least.get(root[value])) for (key, _), value in zip(rows, prints, strict=True)), key=str
    )


def found(df):
    return sorted(((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in df.collect()), key=str)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    pick = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in pick.sample(range(64), pick.randint(0, 4)))
        assert any(flips & mask == 0 for mask in masks)


def test_query_equals_brute_force(spark, small, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = queries.QUERIES["op2_simhash"](spark, small).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == expected(rows)


def test_edges(edges, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert found(simhash.near_duplicates(edges)) == expected(rows)
    assert simhash.near_duplicates(no_documents).count() == 0


def test_links_join_what_close_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # buckets of many blocks
    pick = random.Random(2)
    values = set()
    for centre in (0, 2**64 - 1, pick.getrandbits(64), pick.getrandbits(64)):
        for _ in range(60):
            value = centre
            for bit in pick.sample(range(64), pick.randint(0, 6)):
                value ^= 1 << bit
            values.add(value)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = simhash.close_links(spark.createDataFrame(signed, "fp long"))
    rooted = {r["node"] % 2**64: r["root"] for r in simhash.components(links).collect()}
    groups = {}
    for value in values:
        groups.setdefault(rooted.get(value, value - 2**64 if value >= 2**63 else value), set()).add(value)
    root = brute.roots(list(values), 4)
    wanted = {}
    for value in values:
        wanted.setdefault(root[value], set()).add(value)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(links).collect()} == {0}


def test_keep_one_keeps_a_row_of_each_group(edges, no_documents):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    root = brute.roots([brute.simhash(t) for _, t in rows], 4)
    got = [(r["doc_id"], root[brute.simhash(r["text"])]) for r in kept.collect()]
    assert sorted(r for _, r in got) == sorted(set(root.values()))
    assert {1, 3} <= {k for k, _ in got} and None not in {k for k, _ in got}
    assert simhash.keep_one(no_documents).count() == 0
