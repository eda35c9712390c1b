"""Toxicity from subword embeddings averaged into a linear softmax."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
DIMENSIONS = 8
GRAMS = (3, 4, 5)
# Words that are averaged together; a text is as toxic as its worst window.
WINDOW = 4
# Training texts that must hold a subword before its vector is learnt; rarer ones stay zero.
MIN_TEXTS = 4
# Labelled rows, toxic and other, that the model is fitted on at most.
SAMPLE = (1500, 2500)
EPOCHS = 80
THRESHOLD = 0.7
REMEMBERED = 600_000
_EDGES = "\"'`.,;:!?()[]{}<>|*#$%&+=~^_-/\\"


def subwords(word: str) -> list[int]:
    """Buckets of a word and its character n-grams; none if it is only punctuation."""
    core = word.strip(_EDGES)
    if not core:
        return []
    marked = f"<{core}>".encode("utf-16-le")  # two bytes to a character, so that grams are slices
    end = len(marked)
    grams = [marked[i : i + 2 * n] for n in GRAMS for i in range(0, end - 2 * n + 1, 2)]
    return [crc32(g) % BUCKETS for g in (marked, *grams)]


@dataclass
class Model:
    """Subword vectors, softmax weights and biases of two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def margins(self) -> np.ndarray:
        """What each subword adds to the toxic class over the other: the softmax is linear in vectors."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32)


class Scorer:
    """Scores texts from subword margins; remembers the means of words it has seen."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins.tolist(), bias
        self.known: dict[str, float] = {}

    def _word(self, word: str) -> float:
        ids = subwords(word)
        return sum([self.margins[i] for i in ids]) / len(ids) if ids else 0.0

    def score(self, text: str | None) -> float:
        words = (text or "").lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            fresh = {w: self._word(w) for w in {w for w, v in zip(words, found, strict=True) if v is None}}
            self.known.update(fresh)
            found = [fresh[w] if v is None else v for w, v in zip(words, found, strict=True)]
        margin = 0.0
        if words:
            sums = np.concatenate([[0.0], np.cumsum(found)])
            width = min(WINDOW, len(words))
            margin = float((sums[width:] - sums[:-width]).max() / width)
        return float(1 / (1 + np.exp(-np.clip(margin + self.bias, -60, 60))))


# The last model's scorer of this worker, so that tasks share the words it remembers.
_scorers: dict[int, Scorer] = {}


def scorer_of(mark: int, margins: np.ndarray, bias: float) -> Scorer:
    if mark not in _scorers:
        _scorers.clear()
        _scorers[mark] = Scorer(margins, bias)
    return _scorers[mark]


def _summed(to: np.ndarray, values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``values[at]`` added up by ``to``, a part at a time: the arrays of all subwords are long."""
    out = np.zeros(n)
    for begin in range(0, len(to), 1 << 20):
        part = slice(begin, begin + (1 << 20))
        out += np.bincount(to[part], values[at[part]], n)
    return out


def fit(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Train vectors and softmax together by Adam on whole texts.

    A text's margin is a soft maximum over its windows of words, nearly their
    mean at first and sharper each epoch, so that the words that make
    a text toxic are found though only the text is labelled.
    """
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = random.normal(0, 0.3, (2, DIMENSIONS))
    biases = np.zeros(2)
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        # Nothing to learn from: a constant near the only class seen, undecided without any.
        return Model(vectors * 0, weights, np.array([0.0, 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)]))

    vocabulary: dict[str, int] = {}
    tokens, begins, ends, owners = array("i"), array("q"), array("q"), array("q")
    for owner, text in enumerate(texts):
        words = (text or "").lower().split()
        at = len(tokens)
        tokens.extend(vocabulary.setdefault(w, len(vocabulary)) for w in words)
        width = min(WINDOW, len(words))
        first = list(range(at, len(tokens) - width + 1, WINDOW // 2)) if width else [at]
        if width and first[-1] != len(tokens) - width:
            first.append(len(tokens) - width)
        begins.extend(first)
        ends.extend(b + width for b in first)
        owners.extend([owner] * len(first))
    n_words = len(vocabulary)
    flat, lengths = array("i"), np.zeros(n_words, np.int64)
    for number, word in enumerate(vocabulary):
        grams = subwords(word)
        lengths[number] = len(grams)
        flat.extend(grams)
    del vocabulary
    ids = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
    of_word = np.repeat(np.arange(n_words, dtype=np.int32), lengths)
    tokens = np.array(tokens, np.int32)
    begins, ends, owners = (np.array(v, np.int64) for v in (begins, ends, owners))
    widths = np.maximum(ends - begins, 1)
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    # The texts that hold a subword, counted word by word; entries of rare subwords go.
    text_of = np.repeat(np.arange(len(texts), dtype=np.int64), [len((t or "").split()) for t in texts])
    held = np.bincount(np.unique(text_of * n_words + tokens) % max(1, n_words), minlength=n_words)
    common = np.bincount(ids, held[of_word], BUCKETS) >= MIN_TEXTS
    kept = common[ids]
    used = np.flatnonzero(common)
    local = (np.cumsum(common, dtype=np.int32) - 1)[ids[kept]]
    of_word = of_word[kept]
    del ids, flat, kept, text_of
    own = vectors[used]
    per_word = 1.0 / np.maximum(lengths, 1)

    parameters = [own, weights, biases]
    moments = [(np.zeros_like(p), np.zeros(())) for p in parameters]
    rates = (4.0, 0.3, 0.1)
    for epoch in range(epochs):
        sharp = 0.5 + 5.5 * epoch / max(1, epochs - 1)
        own, weights, biases = parameters
        direction = weights[1] - weights[0]
        margins = own @ direction
        word = _summed(of_word, margins, local, n_words) * per_word
        sums = np.r_[0.0, np.cumsum(word[tokens])]
        window = (sums[ends] - sums[begins]) / widths + biases[1] - biases[0]
        top = np.maximum.reduceat(window, starts)
        weight = np.exp(sharp * (window - top[owners]))
        weight /= np.add.reduceat(weight, starts)[owners]
        text_margin = np.add.reduceat(weight * window, starts)
        p = 1 / (1 + np.exp(-np.clip(text_margin, -60, 60)))
        by_text = (p - y) * share
        by_window = by_text[owners] * weight
        change = np.zeros(len(tokens) + 1)
        np.add.at(change, begins, by_window / widths)
        np.add.at(change, ends, -by_window / widths)
        by_word = np.bincount(tokens, np.cumsum(change[:-1]), n_words) * per_word
        by_gram = _summed(local, by_word, of_word, len(used))
        grad_direction = own.T @ by_gram + 1e-4 * direction
        grad_bias = by_text.sum()
        gradients = [
            np.outer(by_gram, direction) + 1e-5 * own,
            np.stack([-grad_direction, grad_direction]),
            np.array([-grad_bias, grad_bias]),
        ]
        for k, gradient in enumerate(gradients):
            first, second = moments[k]
            first += 0.1 * (gradient - first)
            second += 0.05 * (np.square(gradient).sum() - second)
            scale = np.sqrt(second / (1 - 0.95 ** (epoch + 1))) + 1e-12
            parameters[k] = parameters[k] - rates[k] * first / (1 - 0.9 ** (epoch + 1)) / scale
    vectors = np.zeros_like(vectors)
    vectors[used] = parameters[0]
    return Model(vectors, parameters[1], parameters[2])


def held_out(key: Column) -> Column:
    """Rows that labels are never learnt from: a third by the checksum of their key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "toxic",
    sample: tuple[int, int] = SAMPLE,
) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    ``sample`` bounds the rows of each class, chosen by a hash of their key. Only
    these few keys are broadcast and only one whole text of each, the least, comes to the driver,
    however many rows repeat the key. NULL labels and keys are left out; a key labelled
    twice counts as toxic if one label says so.
    """
    known = (
        labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k")))
        .groupBy("k").agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("k"), "k"]
    chosen = known.where("y = 1").orderBy(*order).limit(sample[0]).unionByName(
        known.where("y = 0").orderBy(*order).limit(sample[1])
    )
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"))
    one_each = texts.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = one_each.orderBy("k").toPandas()
    return fit(rows["text"].tolist(), rows["y"].tolist())


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add a score from 0 to 1 for each whole text; an empty or NULL text gets the model's bias alone. Map-only."""
    values = model.margins()
    bias = float(model.biases[1] - model.biases[0])
    mark = crc32(values.tobytes() + np.float64(bias).tobytes())
    margins = docs.sparkSession.sparkContext.broadcast(values)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(mark, margins.value, bias)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, score(F.col(f"`{text}`")))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Repeated rows are scored each. NULL keys count as not held out, and have no label. An
    empty table gives no rows; without labels of both kinds the score is a constant.
    """
    model = train(docs, labels, key, text)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return scored(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns as they were."""
    score = "__toxicity_score"
    return scored(docs, train(docs, labels, key, text), text, score).where(F.col(score) < THRESHOLD).drop(score)
