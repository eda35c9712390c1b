"""Work along the order of keys of any size, against plain windows and Python."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clearledger.operators import records, scans

SCHEMA = "k long, t long, id long, x long, s string"


def some_rows(n=400, seed=5):
    """One key of a third of all rows and a NULL key; times tie, values and texts may be missing."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else pick.choice((None, 1, 2, 3, 4, 5, 6, 7))
        text = pick.choice((None, "", "a", "bc", "é中😀", "word " * 3))
        rows.append((key, pick.randrange(60), i, pick.choice((None, 1, -5, 70)), text))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(some_rows(), SCHEMA).repartition(5)


@pytest.fixture
def many_ranges(spark):
    """Ranges as small as shuffles make them, so that every key of any size is cut."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("block", [3, 10, 100_000])
def test_frames_equal_a_plain_window(table, many_ranges, block):
    frames = {
        "a": lambda w: F.lag("id", 3).over(w), "b": lambda w: F.lead("id").over(w),
        "c": lambda w: F.sum("x").over(w.rowsBetween(-2, 1)), "d": lambda w: F.min("s").over(w.rowsBetween(-3, -1)),
    }
    got = scans.framed(table, ["k"], ["t", "id"], frames, before=3, after=1, totals={"run": F.col("x")}, block=block)
    plain = Window.partitionBy("k").orderBy("t", "id")
    run = F.coalesce(F.sum("x").over(plain.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    want = table.withColumn("run", run).withColumns({n: make(plain) for n, make in frames.items()})
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_frames_longer_than_a_block_are_refused(table):
    with pytest.raises(ValueError):
        scans.framed(table, ["k"], ["t"], {}, before=5, block=4)


def joined(rows, separator=""):
    texts = defaultdict(list)
    for key, _, _, _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        texts[key].append(text or "")
    return {key: separator.join(parts) for key, parts in texts.items()}


@pytest.mark.parametrize(("limit", "separator"), [(1, ""), (7, "\n"), (7, ", "), (64, ""), (1 << 20, "\n")])
def test_texts_in_pieces(table, many_ranges, limit, separator):
    got = scans.ordered_texts(table, ["k"], ["t", "id"], "s", separator, limit).collect()
    whole = defaultdict(dict)
    for r in got:
        whole[r["k"]][r["piece"]] = r["text"]
    want = joined(some_rows(), separator)
    assert {k: "".join(p[i] for i in sorted(p)) for k, p in whole.items()} == want
    for key, pieces in whole.items():
        assert sorted(pieces) == list(range(len(pieces)))
        assert len(pieces) == max(1, -(-len(want[key]) // limit))
        assert all(len(pieces[i]) == limit for i in range(len(pieces) - 1))


def test_texts_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0, None, None), (1, 1, 1, None, ""), (2, 0, 2, None, "")], SCHEMA)
    got = scans.ordered_texts(df, ["k"], ["t"], "s", limit=4)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, ""), (2, 0, "")]
    assert scans.ordered_texts(df.where("false"), ["k"], ["t"], "s").count() == 0


def test_long_response_and_prompt(spark, many_ranges):
    """A session longer than a row may be, one of no text, and a question alone."""
    long = ["x" * 37 + str(i) for i in range(50)]
    events = [(1, i, f'{{"contentBlockDelta":{{"delta":{{"text":"{t}"}}}}}}') for i, t in enumerate(long)]
    events += [(2, 0, '{"messageStart":{}}'), (2, 1, None), (None, 5, '{"contentBlockDelta":{"delta":{"text":"lost"}}}')]
    got = records.session_texts(spark.createDataFrame(events, "s long, n long, e string"), "s", "n", "e", limit=100).collect()
    pieces = sorted((r["piece"], r["text"]) for r in got if r["s"] == 1)
    assert "".join(t for _, t in pieces) == "".join(long) and len(pieces) == -(-len("".join(long)) // 100)
    assert {(r["s"], r["text"]) for r in got if r["s"] != 1} == {(2, ""), (None, "lost")}
    turns = [(1, i, "user", t) for i, t in enumerate(long)] + [(2, 9, None, "alone"), (3, 0, "user", "a"), (3, 1, "user", None)]
    got = records.prompt_texts(spark.createDataFrame(turns, "k long, n long, r string, c string"), "k", "n", "r", "c", limit=64)
    rows = sorted(got.collect(), key=lambda r: (r["k"], r["piece"]))
    prompt = "Conversation history:\n" + "\n".join(f"User: {t}" for t in long[:-1]) + f"\n\nCurrent question: {long[-1]}"
    assert "".join(r["text"] for r in rows if r["k"] == 1) == prompt
    assert [(r["text"], r["complete"]) for r in rows if r["k"] == 2] == [("alone", True)]
    assert [r["complete"] for r in rows if r["k"] == 3] == [False]


@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof_equals_nested_loops(spark, many_ranges, tolerance):
    left, right = some_rows(200, 1), some_rows(150, 2)
    right += [(3, None, 900, 1, "no time"), (None, 1, 901, 1, "no key")]
    left += [(3, None, 902, 1, "no time"), (99, 5, 903, 1, "no match")]
    found = scans.asof_join(
        spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).withColumnRenamed("t", "at"),
        ["k"], "t", "at", ["id"], None if tolerance is None else F.lit(tolerance),
    )
    want = []
    for key, t, i, *_ in left:
        near = [r for r in right if t is not None and r[0] == key and key is not None and r[1] is not None and r[1] <= t]
        best = max(near, key=lambda r: (r[1], r[2]), default=None)
        if best and tolerance is not None and best[1] < t - tolerance:
            best = None
        want.append((i, best and best[2]))
    assert sorted((r["id"], r["match"] and r["match"]["id"]) for r in found.collect()) == sorted(want)


def test_asof_equals_duckdb_on_a_hot_key(spark, many_ranges):
    """Half of the rows have one key."""
    left = [(0 if i % 2 else i % 5, i * 7 % 1000, i) for i in range(600)]
    right = [(0 if i % 2 else i % 5, i * 3, i) for i in range(400)]
    found = scans.asof_join(
        spark.createDataFrame(left, "k long, t long, id long"), spark.createDataFrame(right, "k long, at long, other long"), ["k"], "t", "at",
    )
    values = [",".join(str(r) for r in rows) for rows in (left, right)]
    want = duckdb.sql(
        f"SELECT l.id, r.other FROM (VALUES {values[0]}) l(k, t, id) ASOF LEFT JOIN (VALUES {values[1]}) r(k, seen, other) "
        "ON l.k = r.k AND l.t >= r.seen"
    ).fetchall()
    assert sorted((r["id"], r["match"] and r["match"]["other"]) for r in found.collect()) == sorted(want)
