"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearledger.llm.common import columns_of, stored

TREES = 8
# Distinct vectors that a leaf holds about, and that the forest is fitted on at most.
LEAF = 512
SAMPLE = 16_384
# Sampled vectors that stand for a leaf at least; deeper levels need no sample.
LEAF_SAMPLE = 8
# Leaves that a query takes from the queue: PROBED * leaves ** PROBE_POWER of the whole forest. The first
# NEAREST of them give each query a score that whatever the others add has to reach.
PROBED, PROBE_POWER, NEAREST = 0.8, 0.75, 4
# Vectors, and queries, of one leaf that meet in one task.
CHUNK = 4096
SEED = 11


@dataclass
class Forest:
    """Trees of equal depth: ``depth`` levels split at the sample's medians, ``more`` levels below.

    A node of the upper levels has a direction of its own. The lower levels of a tree
    share a direction each and split at the centre of their upper leaf's sample, so
    that the number of leaves can follow the number of vectors while what is fitted stays small.
    """

    normals: np.ndarray  # tree, node, dimension
    cuts: np.ndarray  # tree, node
    lower: np.ndarray  # tree, level, dimension
    centres: np.ndarray  # tree, upper leaf, level: the centre's product with the level's direction
    depth: int
    more: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.normals)), np.int64)
        rows = np.arange(len(vectors))
        for tree in range(len(self.normals)):
            at = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.normals[tree, at]) > self.cuts[tree, at]
                at = 2 * at + 1 + side
            leaf = at - (2**self.depth - 1)
            own = leaf
            for level in range(self.more):
                side = vectors @ self.lower[tree, level] > self.centres[tree, own, level]
                leaf = 2 * leaf + side
            out[rows, tree] = leaf
        return out

    def nearest_leaves(self, vector: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The ``(tree, leaf)`` that one queue over all trees gives first.

        A node's priority is the least margin by which the vector is on its side of the
        hyperplanes above it; negative where it is on the other.
        """
        margins = np.einsum("tnd,d->tn", self.normals, vector) - self.cuts
        below = np.einsum("tld,d->tl", self.lower, vector)
        upper = 2**self.depth - 1
        queue = [(-math.inf, tree, 0, 0, 0) for tree in range(len(self.normals))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < probes:
            nearness, tree, level, node, leaf = heapq.heappop(queue)
            if level == self.depth + self.more:
                found.append((tree, leaf))
                continue
            if level < self.depth:
                margin = margins[tree, node]
                low, high = 2 * node + 1, 2 * node + 2
                low_leaf, high_leaf = low - upper, high - upper
            else:
                own = node - upper
                margin = below[tree, level - self.depth] - self.centres[tree, own, level - self.depth]
                low = high = node
                low_leaf, high_leaf = 2 * leaf, 2 * leaf + 1
            heapq.heappush(queue, (max(nearness, margin), tree, level + 1, low, low_leaf))
            heapq.heappush(queue, (max(nearness, -margin), tree, level + 1, high, high_leaf))
        return found


def grow(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """A forest for ``total`` vectors, fitted on a sample of them.

    Each node takes the direction between two random vectors of its own and cuts at the
    median, so that all leaves hold about the same.
    """
    random = np.random.default_rng(seed)
    n, dim = sample.shape
    levels = max(0, math.ceil(math.log2(max(1, total) / leaf)))
    depth = min(levels, max(0, int(math.log2(max(1, n / LEAF_SAMPLE)))))
    more = levels - depth
    normals = np.zeros((trees, 2**depth - 1, dim))
    cuts = np.zeros((trees, 2**depth - 1))
    lower = random.normal(size=(trees, more, dim))
    lower /= np.linalg.norm(lower, axis=2, keepdims=True)
    centres = np.zeros((trees, 2**depth, more))
    for tree in range(trees):
        members = [np.arange(n)]
        for level in range(depth):
            split = []
            for place, own in enumerate(members):
                node = 2**level - 1 + place
                pair = random.choice(own, 2, replace=False) if len(own) > 1 else own[[0, 0]]
                way = sample[pair[0]] - sample[pair[1]]
                if not np.any(way):
                    way = random.normal(size=dim)
                way = way / np.linalg.norm(way)
                along = sample[own] @ way
                order = np.argsort(along, kind="stable")
                half = len(own) // 2
                normals[tree, node] = way
                cuts[tree, node] = (along[order[half - 1]] + along[order[half]]) / 2 if half else along[order[0]]
                split.extend((own[order[:half]], own[order[half:]]))
            members = split
        for place, own in enumerate(members):
            centres[tree, place] = lower[tree] @ sample[own].mean(axis=0) if more else 0
    return Forest(normals, cuts, lower, centres, depth, more)


def probes_for(forest: Forest) -> int:
    leaves = len(forest.normals) * 2 ** (forest.depth + forest.more)
    return max(1, min(leaves, math.ceil(PROBED * leaves**PROBE_POWER)))


def _usable(embedding: Column) -> Column:
    """Not NULL, nor zero, nor with a NULL or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _met(k: int):
    """cogroup: for each query of a leaf's part its k best vectors there that reach the query's floor."""

    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "candidate", "least", "score"]
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query": [], "candidate": [], "least": [], "score": []}).astype(
                {"query": "int64", "candidate": "int64", "least": "int64", "score": "float64"}
            )
        matrix = _matrix(vectors["vector"])
        ids, least = (vectors[c].to_numpy(np.int64) for c in ("id", "least"))
        order = np.lexsort((ids, least))  # ties go to the smaller key
        matrix, ids, least = matrix[order], ids[order], least[order]
        out = []
        for begin in range(0, len(queries), 256):
            part = queries.iloc[begin : begin + 256]
            scores = _matrix(part["vector"]) @ matrix.T
            for row, (query, floor) in enumerate(zip(part["query"], part["floor"], strict=True)):
                near = np.flatnonzero(scores[row] >= floor)
                if len(near) > k:
                    near = near[np.argsort(-scores[row, near], kind="stable")[:k]]
                out.append((np.full(len(near), query, np.int64), ids[near], least[near], scores[row, near]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return best


def _search(visits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``query, candidate, least, score`` of the leaves visited. Vectors and queries of a leaf are cut
    into parts of a bounded size, and every two parts meet once."""
    tree = ["tree", "leaf"]
    sizes = stored(
        index.groupBy(*tree).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n_vectors"))
        .join(visits.groupBy(*tree).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n_queries")), tree),
        "ann-sizes",
    )

    def part(column: str, of: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    left = visits.join(sizes, tree).withColumn("vector_part", every("n_vectors"))
    left = left.withColumn("query_part", part("query", "n_queries"))
    right = index.join(sizes, tree).withColumn("query_part", every("n_queries"))
    right = right.withColumn("vector_part", part("id", "n_vectors"))
    keys = [*tree, "vector_part", "query_part"]
    return (
        left.select(*keys, "query", "floor", "vector").groupBy(*keys)
        .cogroup(right.select(*keys, "id", "least", "vector").groupBy(*keys))
        .applyInPandas(_met(k), "query long, candidate long, least long, score double")
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query, each once; ties go to the smaller ``least``, the candidate's first key."""
    once = found.groupBy("query", "candidate", "least").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least", "candidate")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    embedding: str = "embedding",
    k: int = 20,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row that ``is_query`` marks.

    Nearness is the inner product in double precision. Vectors get one more
    component that makes all as long as the longest, so that nearness orders
    like the angle that the trees cut by. The forest is fitted on at most ``sample`` distinct vectors, chosen by
    hash; every vector is indexed. One queue over all trees picks a query's leaves,
    and the vectors in them are scored exactly. The best of its first leaves bound what the others need to send.

    Equal vectors are searched once and share their neighbours; ids are expanded at the
    end, the smallest first. Rows with a NULL key take no part, nor vectors that
    are NULL, zero, hold a NULL or non-finite component, or have another length
    than most (of lengths equally frequent the longest). Repeated rows count once; rows with a query's key are
    its own. Fewer candidates than k are all returned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("vector"), is_query.alias("asks")
    ).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    rows = stored(rows.withColumn("size", F.size("vector")), "ann-rows")
    frequent = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if frequent is None:
        return empty
    dim = frequent["size"]
    rows = rows.where(F.col("size") == dim).drop("size")
    rows = rows.groupBy("vector", "id").agg(F.bool_or(F.coalesce("asks", F.lit(False))).alias("asks"))
    # One class for equal vectors, named by its least id; k + 1 ids are all that a result can show of it.
    place = Window.partitionBy("vector").orderBy("id")
    ids = rows.select("vector", "id").withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    ids = ids.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
    classes = stored(
        ids.join(rows.groupBy("vector").agg(F.bool_or("asks").alias("asks")), "vector").select(
            F.element_at("members", 1).alias("id"), F.monotonically_increasing_id().alias("class"), "vector", "members", "asks"
        ),
        "ann-classes",
    )
    askers = rows.where("asks").join(classes.select("class", "vector"), "vector").select(
        F.col("class").alias("query"), F.col("id").alias("query_id")
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    about = classes.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("longest")).first()
    chosen = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("vector").toPandas()
    longest = float(about["longest"])

    def lengthened(matrix: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", matrix, matrix), 0))
        return np.column_stack([matrix, rest])

    forest = grow(lengthened(_matrix(chosen["vector"])), about["n"], trees, leaf)
    probes = probes_for(forest)
    # Bounded: trees times twice the sample's leaves, whatever the number of vectors.
    shared = spark.sparkContext.broadcast(forest)

    def place_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaves = shared.value.leaves(lengthened(_matrix(batch["vector"])))
            n, many = leaves.shape
            yield pd.DataFrame(
                {
                    "id": np.repeat(batch["class"].to_numpy(np.int64), many),
                    "least": np.repeat(batch["id"].to_numpy(np.int64), many),
                    "tree": np.tile(np.arange(many), n),
                    "leaf": leaves.ravel(),
                    "vector": batch["vector"].repeat(many).to_numpy(),
                }
            )

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                part = batch.iloc[begin : begin + 64]
                out = []
                for query, vector in zip(part["class"], part["vector"], strict=True):
                    longer = np.append(np.asarray(vector, np.float64), 0.0)
                    for order, (tree, where) in enumerate(shared.value.nearest_leaves(longer, probes)):
                        out.append((query, tree, where, order, vector))
                yield pd.DataFrame(out, columns=["query", "tree", "leaf", "order", "vector"])

    kind = dict(classes.dtypes)["vector"]
    spread = spark.conf.get("spark.sql.shuffle.partitions")
    index = classes.select("class", "id", "vector").mapInPandas(
        place_all, f"id long, least long, tree int, leaf long, vector {kind}"
    )
    index = stored(index, "ann-index")
    asked = classes.where("asks").select("class", "vector").repartition(int(spread), "class")
    visits = asked.mapInPandas(visit, f"query long, tree int, leaf long, order int, vector {kind}")
    visits = stored(visits, "ann-visits")

    first = visits.where(F.col("order") < NEAREST).withColumn("floor", F.lit(float("-inf")))
    found = stored(_top(_search(first, index, k + 1), k + 1), "ann-first").drop("place")
    floors = found.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(
        "query", F.when(F.col("n") > k, F.col("least")).otherwise(float("-inf")).alias("floor")
    )
    # A query whose first leaves hold nothing has no floor yet.
    others = visits.where(F.col("order") >= NEAREST).join(floors, "query", "left")
    others = others.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = _top(found.unionByName(_search(others, index, k + 1)), k + 1)

    members = classes.select(F.col("class").alias("candidate"), "members")
    pairs = found.join(members, "candidate").join(askers, "query")
    pairs = pairs.select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
