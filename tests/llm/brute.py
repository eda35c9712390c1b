"""Plain versions of the operators, written from their definitions."""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def lower_ascii(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def simhash(text: str | None, width: int = 4) -> int:
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values: list[int], radius: int) -> dict[int, int]:
    """For each value the least one that links of at most ``radius`` bits reach."""
    parent = {v: v for v in values}

    def find(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= radius:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {v: find(v) for v in parent}


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for found in places.values() if len(found) > 1 for i in found for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, int]]:
    spans = []
    for kind, pattern in enumerate(PLAIN):
        for match in pattern.finditer(text or ""):
            found = match.group()
            digits = re.sub("[^0-9]", "", found)
            fits = (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in found.split(".")))
                or (kind == 2 and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == 3 and 10 <= len(digits) <= 15)
            )
            if fits:
                spans.append((match.start(), kind, match.end()))
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nearest(rows: list[tuple[int, list[float]]], query: int, vector: list[float], k: int) -> list[tuple[float, int]]:
    scores = [(-math.fsum(a * b for a, b in zip(vector, other, strict=True)), i) for i, other in rows if i != query]
    return [(-s, i) for s, i in sorted(scores)[:k]]


def dice(a: list[str], b: list[str]) -> float:
    x, y = (set(zip(w, w[1:], strict=False)) for w in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def segmentations(body: str, pieces: dict[str, float]) -> dict[tuple[str, ...], float]:
    """All ways to write a string as pieces, with the sum of their weights."""
    if not body:
        return {(): 0.0}
    out = {}
    for end in range(1, len(body) + 1):
        if body[:end] in pieces:
            for rest, weight in segmentations(body[end:], pieces).items():
                out[(body[:end], *rest)] = pieces[body[:end]] + weight
    return out
