"""Likeness of texts by their longest common subsequence, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Cells of the table of common lengths that are worked on at once.
CELLS = 1 << 20


def _codes(texts: list[str], width: int, none: int) -> np.ndarray:
    """The characters of the texts, a row each, filled up with a number that is no character."""
    rows = np.full((len(texts), width), none, np.int32)
    for row, text in zip(rows, texts):
        row[:len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    return rows


def _common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, all pairs a character of ``a`` further at a time."""
    left, right = _codes(a, max(map(len, a)), -1), _codes(b, max(map(len, b)), -2)
    best = np.zeros((len(b), right.shape[1] + 1), np.int32)
    for k in range(left.shape[1]):
        longer = np.maximum(best[:, 1:], best[:, :-1] + (right == left[:, k:k + 1]))
        best[:, 1:] = np.maximum.accumulate(longer, axis=1)
    return best[:, -1]


@F.pandas_udf(IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts; null if one is. Pairs of like length are worked on together."""
    found = np.zeros(len(a), np.int32)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    a, b = a.to_numpy(), b.to_numpy()
    sizes = np.array([len(a[i]) + len(b[i]) for i in known], np.int64)
    order = known[np.argsort(-sizes, kind="stable")]
    start = 0
    while start < len(order):
        # The first pair of a group is its longest.
        most = len(a[order[start]]) + len(b[order[start]]) + 1
        some = order[start:start + max(1, CELLS // most)]
        found[some] = _common_lengths([a[i] for i in some], [b[i] for i in some])
        start += len(some)
    out = pd.Series(found, dtype="Int32")
    out[~np.isin(np.arange(len(found)), known)] = pd.NA
    return out


def indel_ratio(a: Column, b: Column) -> Column:
    """1 less the insertions and deletions between two texts over their length together; two empty texts are alike."""
    n, m = F.char_length(a), F.char_length(b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(1 - (n + m - 2 * common_subsequence(a, b)) / (n + m))
