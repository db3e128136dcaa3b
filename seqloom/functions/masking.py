"""SEG: masking of low-complexity segments (Wootton and Federhen).

Windows of `window` residues with low entropy trigger; a trigger grows while the
entropy stays below the high cut; the grown segment is trimmed to the part least
probable by chance; what trimming leaves on the left is searched again.
"""

from __future__ import annotations

import math

import numpy as np

# The amino acids that count, window, entropy cuts in bits, most residues that trimming takes.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
WINDOW, LOW, HIGH, MOST_TRIM = 12, 2.2, 2.5, 100

_PLACE = np.full(256, -1, np.int64)
for _i, _c in enumerate(LETTERS):
    _PLACE[ord(_c)] = _PLACE[ord(_c.lower())] = _i
_LN20 = math.log(20)
_FACTORIALS = np.array([math.lgamma(i + 1) for i in range(1024)])


def _ln_factorial(n: np.ndarray) -> np.ndarray:
    global _FACTORIALS
    if n.size and (top := int(n.max())) >= len(_FACTORIALS):
        _FACTORIALS = np.array([math.lgamma(i + 1) for i in range(2 * top)])
    return _FACTORIALS[n]


def _running(places: np.ndarray) -> np.ndarray:
    """Counts of each letter before each position."""
    one = np.zeros((len(places) + 1, len(LETTERS)), np.int64)
    known = np.flatnonzero(places >= 0)
    one[known + 1, places[known]] = 1
    return one.cumsum(axis=0)


def entropies(places: np.ndarray) -> np.ndarray:
    """Entropy of the window that starts at each position; the last positions repeat the last full window."""
    counts = _running(places)
    w = counts[WINDOW:] - counts[:-WINDOW]
    total = w.sum(axis=1, keepdims=True)
    share = w / np.maximum(total, 1)
    h = -(share * np.log2(np.where(w > 0, share, 1.0))).sum(axis=1)
    return np.concatenate([h, np.full(WINDOW - 1, h[-1])])


def _trim(places: np.ndarray) -> tuple[int, int]:
    """(start, end) of the sub-window that is least likely by chance, at most MOST_TRIM residues shorter."""
    n = len(places)
    counts = _running(places)
    lengths = np.arange(n, max(1, n - MOST_TRIM), -1)
    if not len(lengths):
        return 0, n
    # All windows, longest first and then from left to right: the first of the least likely ones counts.
    length = np.repeat(lengths, n - lengths + 1)
    start = np.concatenate([np.arange(n - k + 1) for k in lengths])
    c = counts[start + length] - counts[start]
    permutations = _ln_factorial(length) - _ln_factorial(c).sum(axis=1)
    assignments = np.full(len(c), _ln_factorial(np.array([20]))[0])
    ordered = np.sort(c, axis=1)
    some = ordered[:, -1] > 0
    same = np.ones(len(c), np.int64)  # size of the class of equal counts so far
    for k in range(1, len(LETTERS)):
        new = ordered[:, k] != ordered[:, k - 1]
        assignments -= np.where(new & some, _FACTORIALS[same], 0)
        same = np.where(new, 1, same + 1)
    assignments -= np.where(some, _FACTORIALS[same], 0)
    p = assignments + permutations - length * _LN20
    i = int(p.argmin())
    return (int(start[i]), int(start[i] + length[i])) if p[i] < 1 else (0, n)


def segments(places: np.ndarray, offset: int = 0) -> list[tuple[int, int]]:
    """(first, end) of the segments to mask."""
    n = len(places)
    if n < WINDOW:
        return []
    h = entropies(places)
    found: list[tuple[int, int]] = []
    i, limit = 0, 0
    low = np.flatnonzero(h <= LOW)
    while True:
        at = np.searchsorted(low, i)
        if at == len(low):
            return found
        i = int(low[at])
        left = i
        while left > limit and h[left - 1] <= HIGH:
            left -= 1
        right = i
        while right + 1 < n and h[right + 1] <= HIGH:
            right += 1
        a, b = _trim(places[left : right + 1])
        first, last = left + a, left + b - 1
        if i < first:
            found += segments(places[left:first], offset + left)
        found.append((offset + first, offset + last + 1))
        i = min(right, last) + 1
        limit = i


def mask(seq: str, letter: str = "x") -> str | None:
    """seq with low-complexity residues replaced; None for a sequence shorter than the window."""
    if len(seq) < WINDOW:
        return None
    out = list(seq)
    for a, b in segments(_PLACE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]):
        out[a:b] = letter * (b - a)
    return "".join(out)
