from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from clearledger.llm import queries, secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_findings(spark).where("crc32(left) % 3 <> 1"))


def test_accuracy_on_findings_held_out(spark, model):
    rated = secrets.scored(secrets.labelled_findings(spark).where("crc32(left) % 3 = 1"), model)
    right = rated.select(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_query_finds_assigned_tokens_and_leaves_the_rest(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    wanted = {(k, m.start(1), m.end(1)) for k, t in docs.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    rows = queries.QUERIES["op9_secrets"](spark, folder).collect()
    got = {(r["doc_id"], *map(int, s.split(":"))) for r in rows for s in r["spans"].split(",") if s}
    assert len(rows) == len(docs) and wanted and wanted <= got
    assert len(got - wanted) <= 0.1 * len(wanted)
    assert sum(r["n_candidates"] for r in rows) > 2 * len(wanted)  # false positives were there to remove


def test_settings(spark, model):
    rows = [
        ('api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', 1), ("fixed in commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", 0),
        ("see https://site/image/gallery/2014.html", 0), ('password = "n4bQgYhMfWWaL+qgxVrQFaO/T"', 1),
        ("number 2390409500648960 of", 0), ("short a1b2c3", 0), ("", 0), (None, 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.secret_scan(docs, model).collect()}
    assert [len(got[i]["secrets"]) for i in range(len(rows))] == [n for _, n in rows]
    [s] = got[0]["secrets"]
    assert rows[0][0][s["start"] : s["end"]] == "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.mark.parametrize(
    "text, value",
    [
        ('password = "Tr0ub4dor&3"', "Tr0ub4dor&3"),
        ("password: correcthorsebatterystaple", "correcthorsebatterystaple"),
        ("api_key=9f86d081884c7d659a2feaa0c55ad015", "9f86d081884c7d659a2feaa0c55ad015"),
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY", "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY"),
        ("key2_secret_access_key = 'wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY'", "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY"),
    ],
)
def test_assigned_values_and_their_spans(spark, model, text, value):
    text = f"\U0001f600 first words, {text} and more"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [row] = secrets.secret_scan(docs, model).collect()
    assert [text[s["start"] : s["end"]] for s in row["secrets"]] == [value]


def test_words_under_such_names_stay(spark, model):
    """Words that the dictionary holds; others are for the forest to judge by their length and letters."""
    texts = ["password: default", 'token = "string"', "the key: value pairs", "auth: module", "a token of b2b trade in q3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.secret_scan(docs, model).collect()
    assert [len(r["secrets"]) for r in rows] == [0] * len(texts)
    assert sum(r["n_candidates"] for r in rows) == 6


def brute_tokens(text):
    """Candidates of a text without assignments: runs with a letter and a digit, less full stops at their ends."""
    found, at = [], 0
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.~-")
    while at < len(text):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        run = text[at:end]
        if run and run[0] != "." and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            size = len(run.rstrip("."))
            found.append((at, at + size))
        at = max(end, at + 1)
    return found


def test_tokens_equal_brute_force(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice("ab1 2.Z/-é,\n") for _ in range(pick.randint(0, 40))) for _ in range(300)]
    texts += ["a1" * 50_000, "a.1" * 50_000, "token" * 50_000, "x " * 50_000 + "z9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in docs.select("text", secrets.found_tokens("text").alias("t")).collect():
        assert [(t["start"], t["end"]) for t in row["t"]] == brute_tokens(row["text"]), row["text"][:60]


def test_words_beside_a_finding_are_whole(spark):
    word = "w" * 5000
    docs = spark.createDataFrame([(f"first {word} then a1b2c3 {word} last d4",)], "text string")
    [tokens] = docs.select(secrets.found_tokens("text")).first()
    assert (tokens[0]["left"], tokens[0]["right"]) == (f"{word} then ", f" {word}")
    assert tokens[1]["left"] == f"{word} last "


def test_edges(spark, model, edges, no_documents):
    got = secrets.secret_scan(edges.withColumn("score", F.lit(1)), model)
    assert got.columns == ["doc_id", "n_candidates", "secrets"]
    wanted = [(r["doc_id"] or 0, len(brute_tokens(r["text"] or ""))) for r in edges.collect()]
    assert sorted((r["doc_id"] or 0, r["n_candidates"]) for r in got.collect()) == sorted(wanted)
    assert secrets.secret_scan(no_documents, model).count() == 0
