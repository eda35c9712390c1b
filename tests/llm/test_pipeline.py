from __future__ import annotations

import brute
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from clearledger.llm import packing, queries
from clearledger.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    names = set(entry_points.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_rules", "near_duplicates", "personal_data", "packing"
    ]


@pytest.fixture(scope="module")
def results(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], small), f"test-{name}"))
    return out


def test_stages_work_on_all_that_was_kept(results):
    docs, calm, good, single, masked, packed = (r.collect() for r in results)
    assert all(r.columns == COLUMNS for r in results[:-1])
    text = {r["doc_id"]: r["text"] for r in docs}
    assert {r["doc_id"] for r in calm} < set(text)
    wanted = set()
    for r in calm:
        n, _, _, _, repeats = brute.quality(r["text"])
        if n >= 50 and 100 * repeats <= 50 * n:
            wanted.add(r["doc_id"])
    assert {r["doc_id"] for r in good} == wanted
    prints = {r["doc_id"]: brute.simhash(r["text"]) for r in good}
    root = brute.roots(list(prints.values()), 4)
    least = {}
    for key, value in prints.items():
        least[root[value]] = min(key, least.get(root[value], key))
    assert sorted(r["doc_id"] for r in single) == sorted(least.values())
    assert {r["doc_id"] for r in masked} == {r["doc_id"] for r in single}
    for r in masked:
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] != text[r["doc_id"]]) == bool(brute.personal(text[r["doc_id"]]))
        assert not [s for s in brute.personal(r["text"]) if s[1] != 0]
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    encode = packing.Encoder(packing.default_tokenizer()).ids
    assert lengths == {r["doc_id"]: len(encode(r["text"])) // 4 + 1 for r in masked}


def test_run_gives_the_last_stage(spark, small, results):
    assert corpus_pipeline.run(spark, small).count() == results[-1].count()


def test_stages_on_edges(spark, small, edges, no_documents):
    docs, none = (d.select(*COLUMNS) for d in (edges, no_documents))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = (stored(stage(spark, d, small), "edges") for d in (docs, none))
        assert docs.columns == COLUMNS and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, small).count() == 0
