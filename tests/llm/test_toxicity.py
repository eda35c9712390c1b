from __future__ import annotations

import zlib

import numpy as np
import pytest

from clearledger.llm import queries, toxicity


@pytest.fixture(scope="module")
def trained(spark):
    """Texts of invented words in which two words, and their kin, make a text toxic."""
    pick = np.random.default_rng(3)
    parts = ["an", "ber", "chi", "dor", "el", "fum", "gra", "hol", "ix", "jon"]
    rows = []
    for i in range(600):
        words = ["".join(pick.choice(parts, pick.integers(1, 4))) for _ in range(pick.integers(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(pick.integers(len(words)), pick.choice(["zwakkel", "zwakkelo", "quorrib", "quorribas"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_held_out_accuracy(trained):
    docs, labels, rows = trained
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_unseen_misspelling_shares_subwords(spark, trained):
    docs, labels, _ = trained
    model = toxicity.train(docs, labels)
    rows = spark.createDataFrame([("chigra holfum zwakkell dorgra",), ("chigra holfum eldor dorgra",), ("",), (None,)], "text string")
    unseen, clean, empty, missing = (r["score"] for r in toxicity.scored(rows, model).collect())
    assert unseen > 0.7 > 0.5 > clean
    assert empty == missing and 0 <= empty <= 1


def test_held_out_labels_are_never_learnt(spark, trained):
    docs, labels, _ = trained
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(string(doc_id)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    one, two = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(one.vectors, two.vectors)


def test_query_learns_from_the_given_labels(spark, small, documents):
    got = queries.QUERIES["op3_toxicity"](spark, small)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == documents.count()
    assert got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.7)").count() == 0


def test_edges(spark, edges, no_documents):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (7, 0), (99, 1)], "doc_id long, toxic int"
    )
    got = toxicity.toxicity(edges, labels)
    assert got.count() == edges.count() and got.where("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.toxicity(no_documents, labels).count() == 0
    nothing = toxicity.toxicity(edges, labels.where("false")).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert toxicity.without_toxic(edges, labels.where("false")).columns == edges.columns


def test_a_repeated_key_is_learnt_once(spark, trained, monkeypatch):
    docs, labels, rows = trained
    learnt = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: learnt.append((texts, toxic)))
    toxicity.train(docs, labels)
    key, text = next(r[:2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1)
    copies = spark.range(2000).selectExpr(f"{key}L AS doc_id", f"IF(id % 3 = 0, NULL, '{text}' || IF(id % 3 = 1, '', ' z')) AS text")
    toxicity.train(docs.unionByName(copies), labels)
    assert learnt[1] == learnt[0]
