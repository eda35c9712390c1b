"""Hard negatives: for each anchor and positive, the nearest rows of other labels within a window of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearledger.llm.common import stored

# Anchors that a task holds, candidates of a tile, and candidates below which a block of anchors is not shared by tasks.
ANCHORS, TILE, SHARE = 4096, 512, 2048
# Sides of at most this length are multiplied plainly.
PLAIN = 32
LONGEST = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product, by seven products of half the size at each level; sides are padded with zeros to be even.

    Sums of int64 wrap, and so do differences: the result is exact if the product itself fits.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= PLAIN:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        padded = strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))
        return padded[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.result_type(a, b))
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two int64 matrices; the shorter rows are padded with zeros.

    A product that an int64 may not hold is an error, never a wrong number.
    """
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    if a.size and b.size:
        most = [max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b)]
        if most[0] * most[1] * wide > LONGEST:
            raise OverflowError("inner products of these vectors may not fit 64 bits")
    return strassen(a, b.T)


class Heaps:
    """The best ``k`` entries of each of many slots: the larger score first, then the smaller id, then the smaller row.

    Entries are kept as sorted columns, so that a tile's entries are merged with all slots at once. ``floor`` and ``last`` are the
    score and id of a full slot's least entry. Heaps of parts of the candidates merge into those of all by offering entries again.
    """

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot = np.zeros(0, np.int64)
        self.score, self.id, self.row = self.slot, self.slot, self.slot
        self.floor = np.full(slots, np.iinfo(np.int64).min)
        self.last = np.full(slots, LONGEST)

    def matters(self, slots: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which of a tile's scores, a row for each of ``slots``, can still enter."""
        floor = self.floor[slots][:, None]
        over, level = scores > floor, scores == floor
        if level.any():
            over |= level & (keys <= self.last[slots][:, None])
        return over

    def offer(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        columns = [np.concatenate(pair) for pair in ((self.slot, slot), (self.score, score), (self.id, key), (self.row, row))]
        order = np.lexsort((columns[3], columns[2], ~columns[1], columns[0]))  # ~ turns the order without overflow
        columns = [c[order] for c in columns]
        slot = columns[0]
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[begins, len(slot)])
        place = np.arange(len(slot)) - np.repeat(begins, sizes)
        self.slot, self.score, self.id, self.row = (c[place < self.k] for c in columns)
        full = begins[sizes >= self.k]
        self.floor[slot[full]], self.last[slot[full]] = columns[1][full + self.k - 1], columns[2][full + self.k - 1]


def _vectors(column: pd.Series) -> np.ndarray:
    """A matrix of integer vectors, shorter ones padded with zeros."""
    rows = column.to_list()
    sizes = {len(r) for r in rows}
    if len(sizes) == 1:
        return np.array(rows, np.int64).reshape(len(rows), sizes.pop())
    out = np.zeros((len(rows), max(sizes)), np.int64)
    for place, row in enumerate(rows):
        out[place, : len(row)] = row
    return out


class _Positives:
    """Best rows of the anchors' own labels; ``slot`` is the anchor."""

    schema = "anchor_row long, anchor_id long, positive_row long, positive_id long, score long"

    def __init__(self, anchors: pd.DataFrame, k: int) -> None:
        self.anchors, self.matrix = anchors, _vectors(anchors["vector"])
        self.rows, self.labels = anchors["row"].to_numpy(np.int64), anchors["label"].to_numpy()
        self.heaps = Heaps(len(anchors), k)

    def tile(self, label: object, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray) -> None:
        own = np.flatnonzero(self.labels == label)
        if not len(own):
            return
        scores = products(self.matrix[own], matrix)
        a, c = np.nonzero(self.heaps.matters(own, scores, ids) & (self.rows[own][:, None] != rows))
        self.heaps.offer(own[a], scores[a, c], ids[c], rows[c])

    def found(self) -> pd.DataFrame:
        h = self.heaps
        keys = self.anchors["id"].to_numpy(np.int64)
        return pd.DataFrame({"anchor_row": self.rows[h.slot], "anchor_id": keys[h.slot], "positive_row": h.row,
                             "positive_id": h.id, "score": h.score})


class _Windows:
    """Best rows of other labels in the windows of the anchors' positives; ``slot`` is anchor and positive."""

    schema = "anchor_row long, place int, negative_row long, negative_id long, score long"

    def __init__(self, anchors: pd.DataFrame, k: int) -> None:
        self.matrix = _vectors(anchors["vector"])
        self.rows, self.labels = anchors["row"].to_numpy(np.int64), anchors["label"].to_numpy()
        bounds = [[(w["low"], w["high"]) for w in windows] for windows in anchors["windows"]]
        self.many = max(len(b) for b in bounds)
        # a window that isn't there is empty
        self.bounds = np.array([b + [(1, 0)] * (self.many - len(b)) for b in bounds], np.int64)
        self.heaps = Heaps(len(anchors) * self.many, k)

    def tile(self, label: object, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray) -> None:
        other = np.flatnonzero(self.labels != label)
        if not len(other):
            return
        scores = products(self.matrix[other], matrix)
        for place in range(self.many):
            slots = other * self.many + place
            low, high = (self.bounds[other, place, side][:, None] for side in (0, 1))
            inside = (scores >= low) & (scores <= high)
            a, c = np.nonzero(inside & self.heaps.matters(slots, scores, ids))
            if len(a):
                self.heaps.offer(slots[a], scores[a, c], ids[c], rows[c])

    def found(self) -> pd.DataFrame:
        h = self.heaps
        return pd.DataFrame({"anchor_row": self.rows[h.slot // self.many], "place": (h.slot % self.many).astype(np.int32),
                             "negative_row": h.row, "negative_id": h.id, "score": h.score})


def _searched(kind: type, k: int):
    """mapInPandas over rows sorted by (block, share, candidate or not, label): the heaps of each block and share.

    A task holds one block of anchors with its heaps and one tile of candidates, which has one label.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchors, holder = None, [], None

        for batch in batches:
            if not len(batch):
                continue
            marks = batch[["block", "share", "asked", "label"]]
            cuts = np.flatnonzero((marks.ne(marks.shift())).any(axis=1).to_numpy())
            for begin, end in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                run = batch.iloc[begin:end]
                mark = tuple(run[["block", "share"]].iloc[0])
                if mark != key:
                    if holder is not None:
                        yield holder.found()
                    key, anchors, holder = mark, [], None
                if not run["asked"].iloc[0]:
                    anchors.append(run)
                    continue
                if holder is None:
                    if not anchors:
                        continue
                    holder = kind(pd.concat(anchors, ignore_index=True), k)
                for at in range(0, len(run), TILE):
                    tile = run.iloc[at : at + TILE]
                    holder.tile(tile["label"].iloc[0], tile["id"].to_numpy(np.int64), tile["row"].to_numpy(np.int64),
                                _vectors(tile["vector"]))
        if holder is not None:
            yield holder.found()

    return search


def _met(anchors: DataFrame, rows: DataFrame, kind: type, k: int, blocks: int, shares: int) -> DataFrame:
    """The heaps of ``kind`` for all blocks of anchors and all shares of the candidates."""

    def every(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    def part(of: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")

    empty = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    if "windows" not in anchors.columns:
        anchors = anchors.withColumn("windows", empty)
    columns = ("block", "share", "asked", "row", "id", "label", "vector", "windows")
    left = anchors.withColumn("block", part(blocks)).withColumn("share", every(shares)).withColumn("asked", F.lit(False))
    right = rows.withColumn("share", part(shares)).withColumn("block", every(blocks))
    right = right.withColumn("asked", F.lit(True)).withColumn("windows", empty)
    return (
        left.select(*columns).unionByName(right.select(*columns))
        .repartition("block", "share").sortWithinPartitions("block", "share", "asked", "label", "id", "row")
        .mapInPandas(_searched(kind, k), kind.schema)
    )


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all anchors.

    Components become ``floor(scale * x)`` and a score is the inner product of two such vectors. For each row that
    ``is_anchor`` marks, its positives are the best other rows of its label; for each of these, the best
    rows of other labels with ``window[0] * positive_score <= 100 * score <= window[1] * positive_score`` are returned. More is better; ties go to the
    smaller key, then to the earlier row.

    The anchors are a stated set and every row is a candidate of each. Blocks of anchors meet shares of the candidates, tile by tile,
    in products of Strassen's kind; a task's heaps hold the best of its share, and those of all shares are merged. First the
    tiles of an anchor's own label give its positives, then all others the negatives. A label of a third of
    all rows is spread like any other.

    Rows with a NULL key, label or vector or with a NULL or non-finite component take no part. Repeated rows are rows of their own: an anchor
    repeated is an anchor twice, each the other's positive. A shorter vector is filled up with zeros, so an empty one scores 0. An
    anchor without positives, or a positive without a negative in its window, gives no row; so does an empty table. A
    score that 64 bits may not hold is an error. Columns not named are not read.
    """
    spark = vectors.sparkSession
    given = F.col(f"`{embedding}`")
    bad = F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{label}`").alias("label"),
        F.when(~bad, F.transform(given, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    anchors = rows.where("asks").drop("asks")
    rows = rows.drop("asks")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    # Shares only spread the work: a few tasks for each core, less where there are many blocks.
    spread = max(1, 4 * spark.sparkContext.defaultParallelism // blocks)
    shares = max(1, min(-(-rows.count() // SHARE), spread))

    found = _met(anchors, rows, _Positives, positives, blocks, shares)
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "positive_id", "positive_row")
    chosen = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    chosen = stored(chosen, "negatives-positives")

    low, high = window
    # The whole scores in a window: 100 * s >= low * p and 100 * s <= high * p. A negative p has none.
    score = F.col("score").cast("decimal(20,0)")
    bounds = F.struct(
        F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high")
    )
    windows = chosen.groupBy(F.col("anchor_row").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("place", bounds.alias("b")))).alias("sorted")
    ).select("row", F.transform("sorted", lambda s: s["b"]).alias("windows"))
    found = _met(anchors.join(windows, "row"), rows, _Windows, negatives, blocks, shares)
    found = found.withColumn("place", F.col("place") + 1)
    best = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "negative_id", "negative_row")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.join(chosen.withColumnRenamed("score", "positive_score"), ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
