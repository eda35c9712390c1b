from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearledger.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def check(rows, texts, tokenizer, capacity=packing.CAPACITY):
    """Every id in exactly one piece, and sequences gapless from 0 and no longer than the capacity."""
    wanted = sorted((ids_of(tokenizer, text) for text in texts))
    documents = {}
    for r in rows:
        documents.setdefault(r["row"], []).append(r)
    got = []
    for own in documents.values():
        own.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in own)
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert all(r["doc_tokens"] == len(ids) // 4 and r["length"] == len(r["ids"]) // 4 > 0 for r in own)
        got.append(ids)
    assert sorted(got) == wanted
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert not sequences or max(sequences.values()) <= capacity
    return sequences


def test_query(spark, small, documents, tokenizer):
    rows = packing.pack_documents(documents).collect()
    sequences = check(rows, [r["text"] for r in documents.collect()], tokenizer)
    assert sum(sequences.values()) > 0.97 * packing.CAPACITY * len(sequences)
    got = queries.QUERIES["op8_packing"](spark, small).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in got) == sorted(
        (r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in rows
    )


def test_edges(edges, no_documents, tokenizer):
    check(packing.pack_documents(edges).collect(), [r["text"] for r in edges.collect()], tokenizer)
    assert packing.pack_documents(no_documents).count() == 0


@pytest.mark.parametrize("remembered", [0, 5, 1000])
def test_words_give_the_ids_of_whole_texts(tokenizer, remembered):
    encoder = packing.Encoder(packing.default_tokenizer(), remembered)
    pick = random.Random(4)
    parts = ["Don't", "é", "é", "İ", "ΣΑΣ", "x y", "a\x1cb", "\x85", "<|endoftext|>", "ǅ", "ß", "½", "ﬁ", "12.5%", "😀", "中文",
             "­", "'S", "we'll", " ", "K", "ª", "Ⅷ", "..."]
    for _ in range(300):
        text = pick.choice(["", " "]).join(pick.choice(parts) + pick.choice(["", " ", "\n", "\t "]) for _ in range(12))
        assert encoder.ids(text) == ids_of(tokenizer, text)[:-4], repr(text)


@pytest.mark.parametrize("n", [1, 7, 300, 20_000])
def test_patterns_hold_the_demand(n):
    pick = np.random.default_rng(n)
    sizes, counts = np.unique(np.minimum(256, pick.geometric(0.02, n)), return_counts=True)
    demand = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    patterns = packing.cutting_stock(demand, 256)
    held, used = {}, 0
    for pattern, times in patterns:
        assert sum(s * c for s, c in pattern.items()) <= 256 and times > 0
        used += times
        for size, count in pattern.items():
            held[size] = held.get(size, 0) + count * times
    assert held == demand
    least = sum(s * c for s, c in demand.items()) / 256
    assert used <= 1.02 * least + 2
    assert packing.cutting_stock({}, 256) == []


def test_knapsack_equals_enumeration():
    pick = np.random.default_rng(5)
    for _ in range(30):
        sizes = np.sort(pick.choice(np.arange(2, 12), 3, replace=False))
        values = pick.random(3)
        best = max(
            a * values[0] + b * values[1] + c * values[2]
            for a in range(11) for b in range(11) for c in range(11)
            if a * sizes[0] + b * sizes[1] + c * sizes[2] <= 20
        )
        gain, counts = packing.best_pattern(values, sizes, 20)
        assert gain == pytest.approx(best) and counts @ values == pytest.approx(best) and counts @ sizes <= 20


def test_a_hot_length_is_ranked_in_many_groups(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "RANKED", 50)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    check(packing.pack_documents(docs).collect(), ["one two three four five six"] * 2000, tokenizer)


def test_short_pieces_are_bundled_without_rounding():
    for unit, capacity in ((8, 2048), (8, 64), (1, 16)):
        counts = {length: length * 7 % 23 + 1 for length in range(1, capacity + 1)}
        demand, rows = packing.bundles(counts, capacity, unit)
        made, pieces = {}, {}
        for length, first, upto, per, size, base in rows:
            assert pieces.get(length, 0) == first < upto and (upto - first) % per == 0
            assert made.get(size, 0) == base and size <= capacity // unit
            assert per * length <= size * unit < per * length + unit
            assert per == 1 or (per * length == size * unit and 2 * per * length <= capacity)
            pieces[length] = upto
            made[size] = base + (upto - first) // per
        assert pieces == counts and made == demand
        assert all(sum(u - f for n, f, u, per, *_ in rows if n == length and per == 1) < unit
                   for length in range(1, capacity // (2 * unit) + 1) if unit // np.gcd(unit, length) > 1)
    assert packing.bundles({}, 2048, 8) == ({}, [])


def test_many_empty_and_short_texts_leave_little_padding(spark, documents, tokenizer):
    """A third of all texts are empty, as many are of one to five words."""
    own = documents.select("doc_id", "text")
    n = own.count()
    empty = spark.range(n).select((-1 - F.col("id")).alias("doc_id"), F.lit("").alias("text"))
    short = spark.range(n).select(
        (-1_000_000 - F.col("id")).alias("doc_id"), F.expr("repeat('word ', CAST(id % 5 + 1 AS INT))").alias("text")
    )
    docs = own.unionByName(empty).unionByName(short)
    sequences = check(packing.pack_documents(docs).collect(), [r["text"] for r in docs.collect()], tokenizer)
    assert sum(sequences.values()) > 0.99 * packing.CAPACITY * (len(sequences) - 1)
    alone = check(packing.pack_documents(empty.union(empty).union(short)).collect(),
                  [""] * 2 * n + [r["text"] for r in short.collect()], tokenizer)
    assert sum(alone.values()) > 0.99 * packing.CAPACITY * (len(alone) - 1)
