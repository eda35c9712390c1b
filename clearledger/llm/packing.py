"""Packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import math
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearledger.llm.common import columns_of, stored

CAPACITY = 2048
END_ID = 1
# Patterns count in this unit, which bounds the linear program to 256 rows. Pieces of one short length go in
# bundles that fill whole units; other lengths are rounded up.
UNIT = 8
# Words a task remembers the ids of; beyond it the memory is emptied and filled anew.
REMEMBERED = 500_000
# Pieces of one length class that are ranked in one group.
RANKED = 20_000
# Columns priced at most; the program is feasible, only less tight, if it stops there.
PRICED = 4_000
# The share of all sequences by which the program may stay above its bound.
TOLERANCE = 3e-4

# Texts of these characters alone are NFC already, and their case does not hang on
# neighbours; a word between blanks then has the same ids wherever it stands.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u024f]")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is
    printable in Latin-1, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder:
    """Token ids of texts as little-endian bytes, four to an id; remembers words it has seen.

    A text of usual characters is cut at its blanks. A new word is cut by the
    tokenizer's own pattern and its parts go to the tokenizer's model alone, since its
    normalizer has nothing left to do. Other texts go to the tokenizer as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        self.parts = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.bytes = _byte_characters()
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        cut = {w: (w,) if w.isalpha() else self.parts(w) for w in words}
        known = self.known_parts
        if len(known) > self.remembered:
            known.clear()
        new = list({p: None for own in cut.values() for p in own if p not in known})
        mapped = [p.encode().decode("latin-1").translate(self.bytes) for p in new]
        for part, e in zip(new, self.model.encode_batch_fast(mapped, add_special_tokens=False), strict=True):
            known[part] = array("I", e.ids).tobytes()
        return {w: b"".join([known[p] for p in own]) for w, own in cut.items()}

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text) or ("<|" in text and _SPECIAL.search(text)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.remembered:
                self.known.clear()
            fresh = self._fresh(list({w: None for w, ids in zip(words, found, strict=True) if ids is None}))
            self.known.update(fresh)
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``row, doc_id, start, length, doc_tokens, ids`` of whole documents, cut at multiples of the capacity.

    A document is its text's ids and then id 1, so a NULL or empty text is that
    one id. ``ids`` holds little-endian unsigned 32-bit numbers. Map-only.
    """
    path = path or default_tokenizer()
    rows = columns_of(docs, doc_id=key, text=text).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).ids
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.iloc[begin : begin + 512]
                out = []
                for row, doc_id, body in zip(part["row"], part["doc_id"], part["text"], strict=True):
                    ids = encode(body) + end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        own = ids[4 * at : 4 * (at + capacity)]
                        out.append((row, doc_id, at, len(own) // 4, n, own))
                yield pd.DataFrame(out, columns=["row", "doc_id", "start", "length", "doc_tokens", "ids"])

    schema = f"row long, doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    return rows.mapInPandas(cut, schema)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the counts of greatest total value that fit."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits := fitting[room]:
            gains = best[room - sizes[:fits]] + values[:fits]
            top = gains.argmax()
            if gains[top] > best[room] + 1e-12:
                best[room], taken[room] = gains[top], top
    counts = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({size: count}, times)`` that hold exactly the demanded number of each size.

    The linear program over patterns starts with one size to a pattern; each
    round prices a new pattern with the duals and pivots it into the basis. Its solution is
    rounded down, and what is left, less than a sequence for each pattern, is packed with the
    largest sizes first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), np.int64)
    if not len(sizes):
        return []
    left = np.array([demand[int(s)] for s in sizes], np.int64)
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = left / (capacity // sizes)
    for round_ in range(PRICED):
        gain, column = best_pattern(inverse.sum(axis=0), sizes, capacity)
        # The optimum is at least the present total over the gain: nothing worth a sequence is left.
        if gain <= 1 + 1e-7 or x.sum() * (1 - 1 / gain) < max(0.5, TOLERANCE * x.sum()):
            break
        way = np.einsum("ij,j->i", inverse, column.astype(float))
        ahead = np.flatnonzero(way > 1e-9)
        ratios = x[ahead] / way[ahead]
        leaving = ahead[int(ratios.argmin())]
        step = ratios.min()
        x = np.maximum(x - step * way, 0)
        x[leaving] = step
        basis[:, leaving] = column
        row = inverse[leaving] / way[leaving]
        inverse -= np.outer(way, row)
        inverse[leaving] = row
        if round_ % 100 == 99:  # a Newton step takes the rounding of the updates out
            product = np.einsum("ij,jk->ik", basis, inverse)
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, product)
            x = np.maximum(np.einsum("ij,j->i", inverse, left), 0)
    patterns = []
    for j in np.argsort(-x):
        column = basis[:, j].round().astype(np.int64)
        used = column > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[used] // column[used]).min()))
        if times > 0:
            left -= times * column
            patterns.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(used)}, times))
    while left.any():
        room, column = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        used = column > 0
        times = int((left[used] // column[used]).min())
        left -= times * column
        patterns.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(used)}, times))
    return patterns


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(size, first rank, last rank + 1, count in a sequence, first sequence)`` for ranked pieces."""
    used: dict[int, int] = {}
    sequence, rows = 0, []
    for pattern, times in patterns:
        for size, count in pattern.items():
            first = used.get(size, 0)
            rows.append((size, first, first + count * times, count, sequence))
            used[size] = first + count * times
        sequence += times
    return rows


def bundles(
    counts: dict[int, int], capacity: int, unit: int
) -> tuple[dict[int, int], list[tuple[int, int, int, int, int, int]]]:
    """The demand of items by size in units, and how pieces of each length make items.

    The rows are ``(length, first piece, last + 1, pieces in an item, size, first item of that size)``. The fewest pieces
    of a length that fill whole units are one item, unless they take over half a sequence; what is left of
    such a length, fewer pieces than an item's, and all longer ones are items of their own, rounded up.
    """
    demand: dict[int, int] = {}
    rows = []
    for length, n in sorted(counts.items()):
        together = unit // math.gcd(unit, length)
        if 2 * together * length > capacity:
            together = 1
        whole = n // together
        for first, upto, per, items in ((0, whole * together, together, whole), (whole * together, n, 1, n - whole * together)):
            if items:
                size = -(-per * length // unit)
                rows.append((length, first, upto, per, size, demand.get(size, 0)))
                demand[size] = demand.get(size, 0) + items
    return demand, rows


def packed(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces: each in one sequence, gapless from 0.

    Only the histogram of lengths, ``capacity`` counts at most, reaches the
    driver, and patterns for it go back. Pieces are ranked within their length by
    groups of bounded size whose counts are added up, so that a length may hold any share of all rows.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    demand, makes = bundles(counts, capacity, unit)
    patterns = cutting_stock(demand, capacity // unit)
    groups = max(1, -(-max(counts.values(), default=0) // RANKED))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")
    )
    order = Window.partitionBy("length", "part").orderBy("row", "start")
    ranked = cut.join(offsets, ["length", "part"]).withColumn("place", F.col("earlier") + F.row_number().over(order) - 1)
    # Two rows for each length and one for each size of a pattern: constant bounds, whatever the number of documents.
    items = spark.createDataFrame(makes, "length long, begin long, finish long, per long, size int, base long")
    table = spark.createDataFrame(slots(patterns), "size int, first long, upto long, count long, sequence long")
    placed = ranked.join(F.broadcast(items), "length").where("place >= begin AND place < finish")
    placed = placed.withColumn("rank", F.expr("base + (place - begin) div per"))
    placed = placed.join(F.broadcast(table), "size").where("rank >= first AND rank < upto")
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - first) div count"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))
    return placed.select(*cut.drop("part").columns, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    values: tuple[str, ...] = ("ids",),
) -> DataFrame:
    """``row, doc_id, start, length, doc_tokens, sequence_id, offset`` and ``values`` per piece of all documents.

    ``values`` are SQL expressions over a piece's ``ids``, the ids themselves unless others are given. Places are found
    for lengths alone, and a piece's values join them in one shuffle at the end.

    A NULL or empty text is packed as its closing id. Repeated rows and NULL keys are
    documents of their own. Very long texts are cut into full sequences and a rest. An
    empty table gives no pieces. Columns besides the two named are not read.
    """
    cut = stored(pieces(docs, key, text, path), "packing-pieces")
    placed = packed(cut.select("row", "start", "length")).drop("length")
    own = cut.select("row", "doc_id", "start", "length", "doc_tokens", *map(F.expr, values))
    return own.join(placed, ["row", "start"])
