from __future__ import annotations

import math
import random
from collections import Counter

import brute
import pytest

from clearledger.llm import queries, segmentation

PIECES = {"a": -1.0, "b": -1.5, "ab": -1.2, "ba": -2.0, "aba": -2.2, "bb": -0.7}


def lattice(body):
    edges = [[] for _ in range(len(body) + 1)]
    for begin in range(len(body)):
        for end in range(begin + 1, len(body) + 1):
            if body[begin:end] in PIECES:
                edges[end].append((begin, (body[begin:end],), PIECES[body[begin:end]]))
    return edges


def test_draws_are_distinct_and_complete():
    every = brute.segmentations("abab", PIECES)
    found, following = segmentation.sampled_paths(lattice("abab"), 100, random.Random(1))
    assert {tuple(ids) for ids, _, _ in found} == set(every) and len(found) == len(every)
    assert following == -math.inf
    total = math.log(sum(map(math.exp, every.values())))
    for ids, logp, _ in found:
        assert logp == pytest.approx(every[tuple(ids)] - total)
    values = [g for _, _, g in found]
    assert values == sorted(values, reverse=True)


def test_draws_follow_the_distribution_without_replacement():
    every = brute.segmentations("abba", PIECES)
    weights = {p: math.exp(w) for p, w in every.items()}
    total = sum(weights.values())
    draw, n = random.Random(2), 20_000
    first, both = Counter(), Counter()
    estimate = Counter()
    for _ in range(n):
        found, following = segmentation.sampled_paths(lattice("abba"), 2, draw)
        one, two = (tuple(ids) for ids, _, _ in found)
        first[one] += 1
        both[one, two] += 1
        for ids, logp, _ in found:
            estimate[tuple(ids)] += math.exp(logp) / segmentation.inclusion(logp, following)
    for path, weight in weights.items():
        p = weight / total
        assert first[path] / n == pytest.approx(p, abs=0.02)
        # weighting by the inclusion score is unbiased
        assert estimate[path] / n == pytest.approx(p, abs=0.02)
        for other, weight_other in weights.items():
            if other != path:
                assert both[path, other] / n == pytest.approx(p * weight_other / (total - weight), abs=0.02)


TEXTS = ["hello world", "  two  spaces ", "é中😀\n\ttab", "x", " ", "", None, "a" * 300, "word " * 400, "▁"]


def test_round_trip_and_repeatability(spark):
    rows = spark.createDataFrame(
        [(i, None if i == 3 else "k", t) for i, t in enumerate(TEXTS)] + [(0, "k", TEXTS[0])],
        "id long, `my key` string, text string",
    )
    keys = ("id", "my key")
    drawn = segmentation.decoded(segmentation.sampled_segmentations(rows, keys, k=3))
    got = drawn.collect()
    for r in got:
        assert r["decoded"] == TEXTS[r["id"]].replace("▁", " ") and 0 <= r["inclusion"] <= 1
    assert {r["id"] for r in got} == {0, 1, 2, 3, 4, 7, 8, 9}
    samples = {}
    for r in got:
        samples.setdefault((r["id"], r["sample"]), set()).add(tuple(r["ids"]))
    assert all(len(v) == 1 for v in samples.values())  # equal keys and texts, equal samples
    assert len({next(iter(v)) for (i, _), v in samples.items() if i == 8}) == 3
    again = segmentation.sampled_segmentations(rows.repartition(7), keys, k=3).collect()
    assert sorted((r["id"], r["sample"], tuple(r["ids"])) for r in again) == sorted(
        (r["id"], r["sample"], tuple(r["ids"])) for r in got
    )
    assert segmentation.sampled_segmentations(rows.where("false"), keys).count() == 0


def test_encoding_is_the_models_own(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=segmentation.default_model())
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for r in segmentation.decoded(segmentation.encoded(rows, ("id",))).collect():
        text = TEXTS[r["id"]] or ""
        assert r["ids"] == model.encode(text) and r["decoded"] == model.decode(model.encode(text))


def test_query_decodes_to_the_whole_texts(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    got = queries.QUERIES["op7_segmentations"](spark, small)
    rows = got.collect()
    hashes = {(r["conv_id"], r["turn"]): r["h"] for r in turns.selectExpr("conv_id", "turn", "xxhash64(text) AS h").collect()}
    assert all(hashes[r["conv_id"], r["turn"]] == r["text_hash"] for r in rows)
    assert len(rows) == 4 * turns.where("length(text) > 0").count()
    assert len({(r["conv_id"], r["turn"], r["ids_hash"]) for r in rows}) == len(rows)
