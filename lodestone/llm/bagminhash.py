"""BagMinHash signatures of word-shingle multisets, in numpy over many texts at once.

A shingle of weight w covers the weights (0, w]. These are cut into the intervals (0, 1], (1, 2], (2, 4], (4, 8] and so
on; each interval of each shingle has a Poisson process of its own, seeded by both, whose rate is the interval's length.
A point has a time, a signature place and a weight; it counts where its weight is at most w, so texts in which a shingle
has different weights share the points up to the smaller one. A place keeps its earliest point, and two texts agree at a
place with the probability of their weighted Jaccard similarity. A process ends when its time passes the text's latest.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
BANDS, ROWS = 26, 5
PLACES = BANDS * ROWS
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
P, P_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    x = np.full(n + 1, base, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of WORDS words, in no order. Words are what white space or control bytes
    part, ASCII letters in lower case. A text of fewer words has one shingle of all it has, one without words has none."""
    raw = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    x = np.frombuffer(b"\n".join([b"", *raw, b""]), dtype=np.uint8)
    gap = x <= 32
    edge = np.diff(gap.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # a word's hash is its part of a running sum of bytes times powers, moved back to power 0
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(P, len(x) - 1), dtype=np.uint64)])
    word = mix((run[end] - run[start]) * powers(P_INVERSE, len(x) - 1)[start])
    del run
    first = np.cumsum([1] + [len(b) + 1 for b in raw])[:-1]
    text = np.searchsorted(first, start, side="right") - 1
    n = len(word)
    h = word.copy()
    for j in range(1, WORDS):
        h[: n - j] = mix(h[: n - j] * np.uint64(P) + word[j:])
    whole = np.zeros(n, dtype=bool)
    whole[: max(0, n - WORDS + 1)] = text[: max(0, n - WORDS + 1)] == text[WORDS - 1 :]
    some, at, count = np.unique(text, return_index=True, return_counts=True)
    for i, c in zip(at[count < WORDS].tolist(), count[count < WORDS].tolist()):
        acc = word[i : i + 1]
        for j in range(1, c):
            acc = mix(acc * np.uint64(P) + word[i + j : i + j + 1])
        h[i], whole[i] = mix(acc + np.uint64(c))[0], True
    return text[whole].astype(np.int64), h[whole]


def multisets(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of the distinct shingles, in order of text and hash."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and element of every shingle occurrence, in order of text: the k-th occurrence of a shingle is one element in
    all texts, so overlaps of multisets are counts of equal elements."""
    text, h, weight = multisets(*shingles(texts))
    turn = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(text, weight), np.repeat(h, weight) + turn.astype(np.uint64) * np.uint64(P)


def signatures(n: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(n, PLACES) times of the earliest points; infinite for a text without shingles."""
    low = np.zeros(len(h), dtype=np.float64)
    size = np.ones(len(h), dtype=np.float64)
    parts = [(text, h, weight, low, size)]
    level, heavy = 1, weight > 1
    while heavy.any():
        k = int(heavy.sum())
        parts.append((text[heavy], mix(h[heavy] + np.uint64(level * 0x632BE59BD9B4E019 % (1 << 64))), weight[heavy], np.full(k, 2.0 ** (level - 1)), np.full(k, 2.0 ** (level - 1))))
        level += 1
        heavy = weight > 2 ** (level - 1)
    text, seed, weight, low, size = (np.concatenate(c) for c in zip(*parts))
    weight = weight.astype(np.float64)
    time = np.zeros(len(seed))
    best = np.full(n * PLACES, np.inf)
    while len(seed):
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        other = mix(seed ^ np.uint64(0xD1B54A32D192ED03))
        time = time - np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (PLACES * size)
        place = ((other >> np.uint64(32)) * np.uint64(PLACES)) >> np.uint64(32)
        counts = low + (other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size < weight
        np.minimum.at(best, text[counts] * PLACES + place[counts].astype(np.int64), time[counts])
        go = time < best.reshape(n, PLACES).max(axis=1)[text]
        text, seed, weight, low, size, time = text[go], seed[go], weight[go], low[go], size[go], time[go]
    return best.reshape(n, PLACES)


def describe(texts: list[str]) -> list[tuple[bytes, int, bytes]]:
    """For each text: digest of its multiset, number of shingles, a byte for each place."""
    text, h, weight = multisets(*shingles(texts))
    bits = mix(signatures(len(texts), text, h, weight).view(np.uint64)).astype(np.uint8)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    total = np.concatenate([[0], np.cumsum(weight)])
    both = np.stack([h, weight.astype(np.uint64)], axis=1)
    cut = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
    return [(hashlib.md5(both[a:b].tobytes()).digest(), int(total[b] - total[a]), bits[i].tobytes()) for i, (a, b) in enumerate(cut)]


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingle multisets; two texts without words have 1."""
    return similarities([a], [b])[0]


def similarities(left: list[str], right: list[str]) -> list[float]:
    n = len(left)
    text, h, weight = multisets(*shingles(left + right))
    side, pair = text >= n, text % n
    order = np.lexsort((side, h, pair))
    pair, h, weight = pair[order], h[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(pair[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=n)
    total = np.bincount(pair, weights=weight, minlength=n)
    return np.where(total > 0, both / np.maximum(total - both, 1), 1.0).tolist()
