"""Near-duplicates by SimHash, found with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearledger.llm.common import columns_of, stored

BITS = 64
SEED = 42
# Fingerprints of one bucket that a task compares at a time with those of another block.
BLOCK = 1024
# Shingles whose bits are counted at a time, which bounds the memory a long text takes.
COUNTED = 1 << 16
# The working column beside those of a caller's table.
MARK = "__simhash_mark"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; of the whole text if it has fewer, none without words."""
    lower = (text or "").encode().lower()  # bytes: only A-Z change, only ASCII blanks divide
    words = lower.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(gram, SEED) for gram in grams), np.uint64, n)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a whole text; 0 without words."""
    hashes = shingles(text, width)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, n, COUNTED):
        part = hashes[begin : begin + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, name: str = "fp") -> DataFrame:
    """Add the SimHash of ``text`` as a long; a NULL text counts as empty. No shuffle."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.withColumn(name, hashed(F.col(f"`{text}`")))


def covering_masks(radius: int) -> list[int]:
    """Masks such that two words differing in at most ``radius`` bits agree under one of them.

    Every bit position gets a non-zero vector of radius + 1 bits, and every such
    vector v a mask of the positions whose vector has an odd product with v. At most
    ``radius`` positions leave a v whose products with all of them are even: its
    mask holds none of these positions.
    """
    n = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, n + 1):
        odd = (i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2)
        masks.append(sum(1 << i for i in odd))
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (least, member) that join the values exactly as all close pairs would."""
    values = np.unique(values)
    words = values.view(np.uint64)
    left = np.ones(len(values), bool)
    links = []
    for first in range(len(values)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            near = np.bitwise_count(words ^ words[queue.pop()]) <= radius
            found = np.flatnonzero(near & left)
            left[found] = False
            queue.extend(found.tolist())
            links.extend((int(values[first]), int(values[i])) for i in found)
    return links


def _links_of_runs(radius: int, keys: list[str]):
    """mapInPandas over rows sorted by ``keys``: the links within each run of equal keys.

    A run holds two blocks of a bucket at most, so what is kept between batches is small.
    """

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            values = rows["fp"].to_numpy(np.int64)
            marks = rows[keys].to_numpy(np.int64)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            pairs = [p for run in np.split(values, cuts) if len(run) > 1 for p in _stars(run, radius)]
            return pd.DataFrame(pairs, columns=["a", "b"], dtype=np.int64)

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            yield found(rows[~last])
            held = rows[last]
        if held is not None and len(held):
            yield found(held)

    return links


def close_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp``, a close pair or a chain of them.

    Two fingerprints are joined by the links exactly if a chain of pairs within
    ``radius`` bits joins them. Each goes to one bucket per mask. A bucket of two is compared in
    place; a larger one is cut into blocks and every two blocks meet in a task of
    their own, so that no bucket has to fit anywhere and no pair is left out.
    """
    masks = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in covering_masks(radius)))
    dealt = fps.select("fp", F.posexplode(masks).alias("mask", "key"))
    full = stored(
        dealt.groupBy("mask", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "simhash-buckets",
    )
    pairs = full.where(f"n = 2 AND bit_count(a ^ b) <= {radius}").select("a", "b")
    large = full.where("n > 2").select("mask", "key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    met = (
        dealt.join(large, ["mask", "key"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.col("mask").cast("long").alias("mask"), "key", "fp",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
    )
    keys = ["mask", "key", "low", "high"]
    linked = (
        met.repartition(*keys).sortWithinPartitions(*keys)
        .mapInPandas(_links_of_runs(radius, keys), "a long, b long")
    )
    return pairs.unionByName(linked).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the least node of its component.

    Large-star and small-star steps in turn until only stars remain, each an
    aggregate and a join on a node; the edges are written between the steps.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "components")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
        one_each = edges.groupBy("u").count().where("count > 1").isEmpty()
        if one_each and edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4
) -> DataFrame:
    """``row, doc_id, fp, component_id`` for each row: its SimHash and its group.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and
    component_id is the smallest doc_id that links reach. ``row`` numbers the rows.

    A NULL or blank text has fingerprint 0 and is linked like any other. Repeated rows
    each give a row. A NULL doc_id takes part, and a component of such rows alone has a NULL
    id. An empty table gives no rows. Columns besides the two named are not read.
    """
    rows = columns_of(docs, doc_id=key, text=text).withColumn("row", F.monotonically_increasing_id())
    marked = stored(fingerprints(rows, width=width).select("row", "doc_id", "fp"), "simhash")
    return grouped(marked, radius).drop("root")


def grouped(marked: DataFrame, radius: int = 4) -> DataFrame:
    """Add component_id, and the component's own root, to rows that have a fingerprint ``fp``."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(close_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return marked.join(named.select("fp", "root", "component_id"), "fp").select(
        "row", "doc_id", "fp", "component_id", "root"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row of each group, that with the smallest key; all columns as they were.

    Rows are told by their key and a hash of their text, so that only these are written, not a
    second copy of the texts. Of rows that are equal in both any one stays.
    """
    own, mark = F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"), F.col(f"`{text}`").isNull())
    rows = fingerprints(docs.select(own.alias("doc_id"), mark.alias("mark"), F.col(f"`{text}`").alias("text")), name="fp")
    marked = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "mark", "fp"), "simhash-rows")
    return _firsts(docs, key, mark, marked, grouped(marked.drop("mark"), radius))


def _firsts(docs: DataFrame, key: str, mark: Column, marked: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group, by ``row, doc_id, mark`` and ``row, doc_id, root``."""
    own = F.col(f"`{key}`")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    chosen = rooted.groupBy("root").agg(first.getField("row").alias("row"))
    chosen = stored(marked.join(chosen.select("row"), "row", "left_semi").select("doc_id", "mark"), "simhash-chosen")
    equal = marked.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = chosen["doc_id"].eqNullSafe(equal["doc_id"]) & (chosen["mark"] == equal["mark"])
    repeated = chosen.join(equal, same, "left_semi")
    working = docs.withColumn(MARK, mark)

    def of(some: DataFrame) -> DataFrame:
        here = own.eqNullSafe(F.col(f"{MARK}_key")) & (F.col(MARK) == F.col(f"{MARK}_mark"))
        picked = some.select(F.col("doc_id").alias(f"{MARK}_key"), F.col("mark").alias(f"{MARK}_mark")).distinct()
        return working.join(picked, here, "left_semi")

    if repeated.isEmpty():
        return of(chosen).drop(MARK)
    once = chosen.join(equal, same, "left_anti")
    return of(once).unionByName(of(repeated).dropDuplicates([key, MARK])).drop(MARK)
