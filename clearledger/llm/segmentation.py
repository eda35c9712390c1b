"""Subword encoding, decoding and sampled segmentations without replacement."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 4
# The scores of this vocabulary are ranks; the smaller this factor, the flatter the distribution.
SHARPNESS = 0.0005
SEED = 5
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model with their scores; characters without a piece are written as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        whole = [
            i for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        usual = [model.get_score(i) for i in whole if model.get_score(i) > -1e8]
        # Pieces without a rank of their own come after all others, bytes after these.
        self.least = min(usual) - 10
        self.pieces = {model.id_to_piece(i): (i, max(model.get_score(i), self.least)) for i in whole}
        # Every beginning of a piece, so that a lattice stops looking where none goes on.
        self.beginnings = {piece[:n] for piece in self.pieces for n in range(1, len(piece) + 1)}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def lattice(self, text: str, sharpness: float) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each position the edges ``(begin, ids, weight)`` that end there."""
        body = SPACE + text.replace(" ", SPACE)
        n = len(body)
        edges: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        pieces, beginnings = self.pieces, self.beginnings
        for begin in range(n):
            end = begin + 1
            part = body[begin:end]
            if part not in pieces:
                ids = tuple(self.bytes[b] for b in part.encode("utf-8", "surrogatepass"))
                edges[end].append((begin, ids, sharpness * (self.least - 10) * len(ids)))
            while part in beginnings:
                if part in pieces:
                    own, score = pieces[part]
                    edges[end].append((begin, (own,), sharpness * score))
                if end == n:
                    break
                end += 1
                part = body[begin:end]
        return edges


def sampled_paths(
    edges: list[list[tuple[int, tuple[int, ...], float]]], k: int, draw: random.Random
) -> tuple[list[tuple[list[int], float, float]], float]:
    """The k first of all segmentations in the order of perturbed log probability, and the next one's.

    Each segmentation's log probability plus independent Gumbel noise orders it; the
    first k are a sample without replacement. The search goes on from the partial
    segmentation of the text's end with the greatest perturbed value below it: its last-but-one
    pieces race, the winner inherits the value and is followed at once, and the others get what the noise
    of all their completions leaves them, which falls with their place in the race, so that only the next
    of them has to wait in the queue. Returns ``(ids, log probability, perturbed)`` and the value of
    number k + 1, minus infinity without one.
    """
    log, exp, log1p, inf, uniform = math.log, math.exp, math.log1p, math.inf, draw.random
    total = [0.0] + [-inf] * (len(edges) - 1)
    # For each position its pieces with their conditional log probability and probability.
    nodes: list[list[tuple[int, tuple[int, ...], float, float]]] = [[]]
    for end in range(1, len(edges)):
        weights = [total[begin] + weight for begin, _, weight in edges[end]]
        top = max(weights, default=-inf)
        here = total[end] = top + log(sum([exp(w - top) for w in weights])) if top > -inf else -inf
        nodes.append(
            [
                (begin, ids, w - here, exp(max(w - here, -700.0)))
                for (begin, ids, _), w in zip(edges[end], weights, strict=True)
                if w > -inf
            ]
        )
    last = len(edges) - 1
    if total[last] == -inf:
        return [], -inf
    found: list[tuple[list[int], float, float]] = []
    queue: list[tuple] = []
    order = 0

    def wait(race: list[tuple[float, int]], place: int, node, bound: float, logp: float, path) -> None:
        """Queue the piece at a place of the race with the value that is left to it."""
        nonlocal order
        time = race[place][0]
        share = race[0][0] / time
        v = bound - logp + log(time) + (log1p(-share) if share < 1.0 else -inf)
        value = bound - max(0.0, v) - log1p(exp(-abs(v)))
        order += 1
        heapq.heappush(queue, (-value, order, race, place, node, bound, logp, path))

    bound, end, logp, path = -log(-log(uniform() or 5e-324)), last, 0.0, None
    while True:
        while end:
            node = nodes[end]
            if len(node) == 1:
                begin, ids, step, _ = node[0]
            else:
                race = sorted([(-log(uniform() or 5e-324) / child[3], i) for i, child in enumerate(node)])
                wait(race, 1, node, bound, logp, path)
                begin, ids, step, _ = node[race[0][1]]
            logp, path, end = logp + step, (ids, path), begin
        if len(found) == k:
            return found, bound
        pieces: list[int] = []
        while path is not None:
            pieces.extend(path[0])
            path = path[1]
        found.append((pieces, logp, bound))
        if not queue:
            return found, -inf
        minus, _, race, place, node, before, logp, path = heapq.heappop(queue)
        if place + 1 < len(race):
            wait(race, place + 1, node, before, logp, path)
        begin, ids, step, _ = node[race[place][1]]
        bound, logp, path, end = -minus, logp + step, (ids, path), begin


def inclusion(logp: float, threshold: float) -> float:
    """The probability that a segmentation's perturbed value is above the threshold."""
    return 1.0 if threshold == -math.inf else -math.expm1(-math.exp(logp - threshold))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _checked(df: DataFrame, keys: tuple[str, ...], column: str, name: str) -> DataFrame:
    return df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{column}`").alias(name))


def _schema(df: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def sampled_segmentations(
    rows: DataFrame,
    keys: tuple[str, ...],
    text: str = "text",
    k: int = SAMPLES,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
    path: str | None = None,
) -> DataFrame:
    """``keys, sample, ids, log_prob, perturbed, inclusion``: distinct segmentations of each whole text.

    Segmentations are drawn without replacement with probability proportional to the exponential of
    ``sharpness`` times their pieces' scores, in the order of ``sample`` from 1. ``inclusion`` is the
    probability of being above number k + 1, whose inverse weights a sample without bias. The draw
    depends on the row's keys and the seed alone, not on where or how often it runs.

    A text with fewer segmentations gives all of them, each with inclusion 1; a NULL or empty text gives none.
    Rows with equal keys and texts have equal samples. Rows are dealt evenly, whatever their keys.
    """
    path = path or default_model()
    # Drawing takes far longer than reading: as many parts as the cluster keeps busy, or more.
    spark = rows.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = _checked(rows, keys, text, "__text").repartition(parts)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        names = [*keys, "sample", "ids", "log_prob", "perturbed", "inclusion"]
        for batch in batches:
            for begin in range(0, len(batch), 256):
                out = []
                for row in batch.iloc[begin : begin + 256].itertuples(index=False, name=None):
                    *key, body = row
                    if not isinstance(body, str) or not body:
                        continue
                    mark = xxhash.xxh64_intdigest("\x00".join(map(repr, key)).encode(), seed)
                    found, following = sampled_paths(words.lattice(body, sharpness), k, random.Random(mark))
                    for number, (ids, logp, perturbed) in enumerate(found, 1):
                        out.append((*key, number, ids, logp, perturbed, inclusion(logp, following)))
                yield pd.DataFrame(out, columns=names)

    schema = f"{_schema(own, keys)}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
    return own.mapInPandas(draw, schema)


def encoded(rows: DataFrame, keys: tuple[str, ...], text: str = "text", path: str | None = None) -> DataFrame:
    """``keys, ids``: the model's own segmentation of each whole text; none for a NULL or empty one."""
    path = path or default_model()
    own = _checked(rows, keys, text, "__text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = vocabulary(path).model
        for batch in batches:
            out = batch[list(keys)].copy()
            out["ids"] = [model.encode(t) if isinstance(t, str) else [] for t in batch["__text"]]
            yield out

    return own.mapInPandas(encode, f"{_schema(own, keys)}, ids array<int>")


def decoded(rows: DataFrame, ids: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text that ids stand for; empty for none, NULL for NULL."""
    path = path or default_model()

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        model = vocabulary(path).model
        return pd.Series([None if x is None else model.decode([int(i) for i in x]) for x in column], dtype=object)

    return rows.withColumn(name, decode(F.col(f"`{ids}`")))
