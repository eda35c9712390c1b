"""Licence notices and texts found in documents by their word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearledger.llm.licence_texts import TEMPLATES

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Normalised words: letters and digits, found in the text as it is, then each in lower case."""
    return [word.lower() for word in _WORD.findall(text)]


@dataclass(frozen=True)
class Template:
    name: str
    bigrams: frozenset[tuple[str, str]]

    def bounds(self, threshold: float) -> tuple[float, float]:
        """The fewest and most bigrams a passage can have and still reach the threshold."""
        size = len(self.bigrams)
        return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def templates_of(texts: Mapping[str, str]) -> list[Template]:
    made = []
    for name, text in texts.items():
        own = words(text)
        bigrams = frozenset(zip(own, own[1:], strict=False))
        if bigrams:
            made.append(Template(name, bigrams))
    return made


def _passages(pairs: list[tuple[str, str]], hits: list[int], template: Template, threshold: float):
    """``(dice, first, last)`` of the best passage, in bigrams, from each hit on, if it reaches the threshold.

    Only a bigram's first place in a passage changes its coefficient. ``ahead`` holds these places for passages
    from ``first`` on, in order, and passing a place puts the bigram's next one in. So a passage ends by
    the size bound on its distinct bigrams, however often it repeats them, and a start costs no more than that bound.
    """
    size, most = len(template.bigrams), int(template.bounds(threshold)[1] + 1e-9)
    end = hits[-1] + 1
    later: dict[int, int] = {}
    nearest: dict[tuple[str, str], int] = {}
    for place in range(end - 1, hits[0] - 1, -1):
        if pairs[place] in nearest:
            later[place] = nearest[pairs[place]]
        nearest[pairs[place]] = place
    ahead = sorted(nearest.values())
    hit = np.zeros(end, dtype=bool)
    hit[hits] = True
    sizes = size + np.arange(1, most + 1)
    found = []
    for first in range(hits[0], end):
        if hit[first]:
            places = np.asarray(ahead[:most])
            dice = 2 * np.cumsum(hit[places]) / sizes[: len(places)]
            best = int(np.argmax(dice))
            if dice[best] >= threshold:
                found.append((float(dice[best]), first, int(places[best])))
        ahead.pop(0)
        if first in later:
            insort(ahead, later[first])
    return found


def scan(text: str | None, templates: list[Template], threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """``(name, dice, first word, last word)`` of the licence passages in a whole text, in order.

    A passage ends with the word that completes its bigrams; repeats after it are left out. Of
    passages that overlap the one with the greatest coefficient stays, then the
    longer, then the earlier, then the first name.
    """
    own = words(text or "")
    pairs = list(zip(own, own[1:], strict=False))
    known: dict[tuple[str, str], list[int]] = {}
    for t, template in enumerate(templates):
        for pair in template.bigrams:
            known.setdefault(pair, []).append(t)
    return _scan(pairs, known, templates, threshold)


def _scan(pairs, known, templates, threshold):
    hits: dict[int, list[int]] = {}
    for place, pair in enumerate(pairs):
        if pair in known:
            for t in known[pair]:
                hits.setdefault(t, []).append(place)
    found = []
    for t, places in hits.items():
        template = templates[t]
        fewest = template.bounds(threshold)[0] - 1e-9
        if len(places) >= fewest and len({pairs[p] for p in places}) >= fewest:
            found.extend(
                (-dice, first - last, first, template.name, last)
                for dice, first, last in _passages(pairs, places, template, threshold)
            )
    # Passages taken share no word, so only the neighbours of a new one can overlap it.
    taken: list[tuple[int, int, str, float]] = []
    for dice, _, first, name, last in sorted(found):
        at = bisect_left(taken, (first,))
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last + 1):
            taken.insert(at, (first, last + 1, name, -dice))
    return [(name, dice, first, last) for first, last, name, dice in taken]


def licence_scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    texts: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, licence, dice, start, end`` (code points, end exclusive) for each licence passage.

    A passage is a run of words whose set of bigrams has a Dice coefficient of at
    least ``threshold`` with a template's. Whole texts are scanned where they lie; nothing is shuffled.
    A NULL, empty or one-word text has none. Repeated rows are scanned each. An empty
    table gives no rows. Columns besides the two named are not read. A very long text costs its
    length times the bigrams of the templates that it could hold.
    """
    templates = templates_of(texts)
    known: dict[tuple[str, str], list[int]] = {}
    for t, template in enumerate(templates):
        for pair in template.bigrams:
            known.setdefault(pair, []).append(t)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    columns = ["doc_id", "licence", "dice", "start", "end"]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, body in zip(batch["doc_id"], batch["text"], strict=True):
                own = words(body)
                passages = _scan(list(zip(own, own[1:], strict=False)), known, templates, threshold)
                if passages:
                    spans = [m.span() for m in _WORD.finditer(body)]
                    for name, dice, first, last in passages:
                        out.append((doc_id, name, dice, spans[first][0], spans[last][1]))
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(found, f"doc_id {kind}, licence string, dice double, start long, end long")
