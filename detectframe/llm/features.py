"""Hashed byte n-grams and word n-grams of many texts at once, and linear hinge-loss fits by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from detectframe.llm.common import chunks, word_hashes

#: Bytes of text whose n-grams are made at once: the arrays of such a step take some 50 times as much.
GRAM_BYTES = 1 << 17
#: Bytes as they are; and A-Z lower-cased with every other ASCII character as a space.
RAW = np.arange(256, dtype=np.uint8)
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def byte_grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Slot in ``2**bits`` of the n-gram (n <= 8) that starts at each byte; the last n-1 places run into what follows."""
    x = data.astype(np.uint64)
    key = x.copy()
    for i in range(1, n):
        key[:-i] |= x[i:] << np.uint64(8 * i)
    key = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return ((key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int32)


def slots(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, slots)`` of all n-grams inside each text, with repeats."""
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        part = table[data[lo:hi]]
        found = [(n, byte_grams(part, n, bits)) for n in orders]
        for row in range(a, b):
            s, e = int(offsets[row]) - lo, int(offsets[row + 1]) - lo
            yield row, np.concatenate([g[s : max(s, e - n + 1)] for n, g in found])


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear L1-loss support vector machine by dual coordinate descent.

    rows: (slots, values) of each example; y: -1 or 1.  Every step solves one dual variable exactly within [0, c].
    """
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            grad = y[i] * (w[at] @ v + w[dim]) - 1.0
            new = min(max(alpha[i] - grad / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[dim] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4 * c:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities (logistic fit by Newton steps, slightly damped)."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum() + 1e-3 * b])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return max(float(a), 1e-3), float(b)


def word_slots(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of space-separated bytes (see ``LETTERS``) and the place where each word starts."""
    h, starts, _ = word_hashes(data, data != 32)
    return (h >> np.uint64(64 - bits)).astype(np.int32), starts


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, dim: int) -> np.ndarray:
    """Log ratio of the smoothed shares of each slot among documents of class 1 and class -1."""
    share = []
    for sign in (1, -1):
        count = np.ones(dim)
        for x, label in zip(rows, y):
            if label == sign:
                count[x] += 1
        share.append(np.log(count / count.sum()))
    return share[0] - share[1]


def bayes_support_vectors(rows: list[np.ndarray], y: np.ndarray, dim: int, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Naive Bayes support vectors over indicator slots: (weight times ratio, squared ratio, shift, share of class 1).

    A document's features are its slots' log-count ratios, scaled to length 1; the margin is turned into a
    probability.  With one class only, every document gets that class's smoothed share.
    """
    n, pos = len(y), int((y > 0).sum())
    if pos in (0, n):
        return np.zeros(dim), np.ones(dim), float(np.log((pos + 1) / (n - pos + 1))), pos / max(n, 1)
    ratio = log_count_ratio(rows, y, dim)
    values = [ratio[x] / max(float(np.linalg.norm(ratio[x])), 1e-9) for x in rows]
    w = hinge_fit(list(zip(rows, values)), y, dim, c)
    margin = np.array([w[x] @ v + w[dim] for x, v in zip(rows, values)])
    slope, shift = sigmoid_fit(margin, y)
    return slope * w[:dim] * ratio, ratio**2, slope * w[dim] + shift, pos / n


def bayes_score(present: np.ndarray, weight: np.ndarray, square: np.ndarray, shift: float) -> float:
    """Probability of class 1 of a document with the slots ``present`` (without repeats)."""
    z = shift
    if len(present):
        z += float(weight[present].sum()) / max(float(np.sqrt(square[present].sum())), 1e-9)
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))
