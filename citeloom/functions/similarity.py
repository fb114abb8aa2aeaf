"""String similarity: local alignment and token subsequences (Arrow UDFs)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of the local alignment.
MATCH, MISMATCH, GAP = 3, -1, -3
#: Abbreviations that are no prefix of their word.
ABBREVIATIONS = frozenset({("boln", "boletin"), ("qld", "queensland")})


def _matrix(a: str, b: str) -> np.ndarray:
    """Scores of local alignments that end at each pair of places."""
    x, y = (np.array([ord(c) for c in s.upper()]) for s in (a, b))
    h = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    slope = -GAP * np.arange(len(y))
    for i in range(len(x)):
        step = np.where(y == x[i], MATCH, MISMATCH)
        best = np.maximum(np.maximum(h[i, :-1] + step, h[i, 1:] + GAP), 0)
        # a gap along the row: the best place before, less its distance
        h[i + 1, 1:] = np.maximum.accumulate(best + slope) - slope
    return h


def _best(x: np.ndarray, y: np.ndarray, low: int, high: int) -> int:
    """The best score among alignments whose places all have low <= j - i <= high; one row of those at a time."""
    n, m = len(x), len(y)
    padded = np.full(max(n + high, m) - low + 1, -1)
    padded[-low : m - low] = y
    size = high - low + 1
    row = np.zeros(size + 1, np.int64)  # by j - i; the last stays 0: beyond the band
    slope = -GAP * np.arange(size)
    most = 0
    for i in range(n):
        step = np.where(padded[i : i + size] == x[i], MATCH, MISMATCH)
        best = np.maximum(np.maximum(row[:-1] + step, row[1:] + GAP), 0)
        row[:-1] = np.maximum.accumulate(best + slope) - slope
        most = max(most, int(row.max()))
    return most


def best_score(a: str, b: str, band: int = 32) -> int:
    """The score of the best local alignment, in memory that grows with the longer string.

    A band around the diagonal suffices where its best is no less than what any alignment that leaves it can have: all
    characters that such a one can still match. Else the band grows, up to all places.
    """
    x, y = (np.array([ord(c) for c in s.upper()]) for s in (a, b))
    n, m = len(x), len(y)
    while True:
        low, high = max(min(0, m - n) - band, -n), min(max(0, m - n) + band, m)
        found = _best(x, y, low, high)
        above = min(n, m - high - 1) if high < m else 0
        below = min(m, n + low - 1) if low > -n else 0
        if found >= MATCH * max(above, below):
            return found
        # what the score found leaves open, at once
        band = max(2 * band, min(n, m) - found // MATCH)


def alignment_score(a: str | None, b: str | None) -> float | None:
    """The best local alignment's score over that of the shorter string with itself; null if a side is missing or empty."""
    if not a or not b:
        return None
    if a == b:
        return 1.0
    return float(best_score(a, b)) / (MATCH * min(len(a), len(b)))


@dataclass(frozen=True)
class Alignment:
    score: float
    spans: tuple[tuple[int, int], tuple[int, int]]
    lines: tuple[str, str, str]


def align(a: str, b: str) -> Alignment:
    """The alignment itself: score, span in each string (end exclusive), and both with a line of bars between them."""
    if not a or not b:
        return Alignment(0.0, ((0, 0), (0, 0)), ("", "", ""))
    h = _matrix(a, b)
    i, j = (int(k) for k in np.unravel_index(int(h.argmax()), h.shape))
    end, top, mid, low = (i, j), [], [], []
    while h[i, j] > 0:
        same = a[i - 1].upper() == b[j - 1].upper()
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
            column = (a[i], "|" if same else " ", b[j])
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
            column = (a[i], " ", "-")
        else:
            j -= 1
            column = ("-", " ", b[j])
        for line, c in zip((top, mid, low), column, strict=True):
            line.append(c)
    lines = tuple("".join(reversed(x)) for x in (top, mid, low))
    return Alignment(float(h.max()) / (MATCH * min(len(a), len(b))), ((i, end[0]), (j, end[1])), lines)


def same_token(a: str, b: str) -> bool:
    """Whether one is a prefix or a known abbreviation of the other, or one edit away."""
    if not a or not b:
        return a == b
    if a.startswith(b) or b.startswith(a):
        return True
    if tuple(sorted((a, b), key=len)) in ABBREVIATIONS:
        return True
    return one_edit(a, b)


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


#: Vocabularies of names are small beside the pairs of their tokens.
_alike = lru_cache(maxsize=1 << 17)(same_token)


def token_lcs(a: str | None, b: str | None) -> float:
    """Twice the longest common subsequence of tokens over the number of both's; 0 if a side is empty.

    A row of the matrix is one whole number with a bit for each token of b, 0 where the row rises (Hyyro 2004).
    """
    x, y = (a or "").split(), (b or "").split()
    if not x or not y:
        return 0.0
    if a == b:
        return 1.0
    places: dict[str, int] = {}
    for j, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << j
    masks = {s: sum(at for t, at in places.items() if _alike(s, t)) for s in set(x)}
    full = row = (1 << len(y)) - 1
    for s in x:
        up = row & masks[s]
        row = ((row + up) | (row - up)) & full
    return 2 * (len(y) - row.bit_count()) / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def _alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alignment_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def alignment(a: Column, b: Column) -> Column:
    """alignment_score of two (normalised) columns."""
    return _alignment(a, b)


def lcs(a: Column, b: Column) -> Column:
    """token_lcs of two columns of joined tokens."""
    return _lcs(a, b)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer string's; 1 if both are empty."""
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.length(a) > 0) & (F.length(b) > 0), i).otherwise(n),
    )
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; null if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest)
