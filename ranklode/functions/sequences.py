"""Alignments of word or vector sequences: batches of Arrow data, one array operation a row of
the table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ranklode.functions.text import col


def best_alignment(gain: np.ndarray) -> float:
    """Greatest sum of gains over pairs (i, j) that rise in both: a running maximum of each row
    replaces the inner loop."""
    best = np.zeros(gain.shape[1] + 1)
    for row in gain:
        best[1:] = np.maximum(best[1:], best[:-1] + row)
        np.maximum.accumulate(best, out=best)
    return float(best[-1]) if gain.size else 0.0


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        """A bit for each word of x, cleared where the subsequence grows: one addition of long
        integers a word of y, so whole documents fit."""
        at: dict = {}
        for k, w in enumerate(x):
            at[w] = at.get(w, 0) | 1 << k
        full = (1 << len(x)) - 1
        left = full
        for w in y:
            if hit := left & at.get(w, 0):
                left = (left + hit | left - hit) & full
        return len(x) - left.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def common_subsequence(a, b) -> Column:
    """Length of the longest common subsequence of two word arrays."""
    return _common(col(a), col(b))


def alignments(distances: np.ndarray, limit: float) -> tuple[float, float, float]:
    """Of a matrix of distances from 0 to 2: pairs within the limit, their similarity, and the
    similarity of all pairs, along the best alignment for each."""
    if limit < 0:
        raise ValueError("the limit must not be negative")
    d = np.asarray(distances, float)
    if not d.size:
        return 0.0, 0.0, 0.0
    alike, close = np.maximum(0.0, 2.0 - d) / 2.0, d <= limit
    return best_alignment(close.astype(float)), best_alignment(np.where(close, alike, 0.0)), best_alignment(alike)


def soft_alignments(df: DataFrame, matrix: str, limit: float) -> DataFrame:
    """The frame with column ``matrix`` (array of rows) replaced by within, fuzzy, total."""

    def run(batches):
        for b in batches:
            rows = [alignments(np.array([list(r) for r in x], float) if x is not None and len(x) else np.zeros((0, 0)), limit) for x in b[matrix]]
            yield b.drop(columns=[matrix]).assign(**{k: [r[i] for r in rows] for i, k in enumerate(("within", "fuzzy", "total"))})

    kept = [f for f in df.schema if f.name != matrix]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "within double, fuzzy double, total double"
    return df.select(*(f.name for f in kept), matrix).mapInPandas(run, ddl)


def without_marks(c) -> Column:
    """Diacritics removed: canonical decomposition without combining marks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn"))

    return run(col(c))

