from __future__ import annotations

import random

import brute

from clearledger.llm import licenses, queries

SOME = {k: licenses.TEMPLATES[k] for k in ("Apache-2.0-line", "MIT-line", "GPL-3.0-line", "CC-BY-4.0")}


def best(text):
    """The greatest coefficient of any run of words with any template."""
    own = licenses.words(text)
    found = [(0.0, "")]
    for name, template in SOME.items():
        wanted = licenses.words(template)
        for first in range(len(own)):
            for last in range(first + 2, len(own) + 1):
                found.append((brute.dice(own[first:last], wanted), name))
    return max(found)


def test_scan_equals_all_windows():
    pick = random.Random(7)
    templates = licenses.templates_of(SOME)
    hit = 0
    for _ in range(120):
        words = licenses.words(pick.choice(list(SOME.values())))
        for _ in range(pick.randint(0, 5)):
            at = pick.randrange(len(words))
            words[at : at + pick.randint(0, 1)] = [pick.choice(["the", "license", "under", "x"])]
        noise = [pick.choice(["the", "of", "license", "version", "work", "is"]) for _ in range(pick.randint(0, 15))]
        text = " ".join(noise + words + noise[::-1])
        value, _ = best(text)
        found = licenses.scan(text, templates)
        if value >= licenses.THRESHOLD - 1e-12:
            assert max(d for _, d, _, _ in found) == value, text
            hit += 1
        else:
            assert found == []
        for name, dice, first, last in found:
            passage = licenses.words(text)[first : last + 1]
            assert abs(dice - brute.dice(passage, licenses.words(SOME[name]))) < 1e-12
    assert 20 < hit < 120


def test_repeated_bigrams_do_not_count_twice(spark):
    text = "released under the x the x the x the mit license"
    [(name, dice, first, last)] = licenses.scan(text, licenses.templates_of(SOME))
    assert (name, dice, first, last) == ("MIT-line", 0.8, 0, 10) and best(text) == (0.8, "MIT-line")


def test_letters_whose_lower_case_is_longer(spark):
    text = "İİİİ said. Released under the MIT License. ẞİ."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [row] = licenses.licence_scan(docs).collect()
    assert text[row["start"] : row["end"]] == "Released under the MIT License" and row["start"] == 11


def test_every_template_is_its_own_best(spark):
    docs = spark.createDataFrame(list(licenses.TEMPLATES.items()), "doc_id string, text string")
    got = {(r["doc_id"], r["licence"], r["dice"]) for r in licenses.licence_scan(docs).collect()}
    assert got == {(name, name, 1.0) for name in licenses.TEMPLATES}


def test_a_text_of_many_notices(spark):
    """Thousands of copies of a notice, all with the same bigrams, give one passage each."""
    text = "\n".join([licenses.TEMPLATES["Apache-2.0"]] * 2000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = licenses.licence_scan(docs).collect()
    assert len(rows) == 2000 and {r["dice"] for r in rows} == {1.0}
    # The last two words add no bigram that the passage doesn't have.
    assert {text[r["start"] : r["end"]] + " the License." for r in rows} == {licenses.TEMPLATES["Apache-2.0"]}


def test_query_finds_the_notices(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    lines = ("This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
             "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.")
    wanted = {(k, line[: -1]) for k, text in docs.items() for line in lines if line in text}
    rows = queries.QUERIES["op6_licenses"](spark, folder).collect()
    got = {(r["doc_id"], docs[r["doc_id"]][r["start"] : r["end"]]) for r in rows if r["dice"] == 1}
    assert wanted == got and wanted


def test_long_licence_with_changes(spark):
    text = "Copyright 2020 A. B. \n" + licenses.TEMPLATES["MIT"].replace("SOFTWARE", "PROGRAM", 1).upper() + " tail"
    docs = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")
    [row] = licenses.licence_scan(docs).collect()
    assert (row["doc_id"], row["licence"]) == (1, "MIT") and 0.95 < row["dice"] < 1


def test_edges(edges, no_documents):
    got = licenses.licence_scan(edges)
    assert got.columns == ["doc_id", "licence", "dice", "start", "end"] and got.count() == 0
    assert licenses.licence_scan(no_documents).count() == 0
