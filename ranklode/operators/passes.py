"""Sequential passes over word arrays that no expression states: batches of Arrow data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def unordered_pairs(query: list[str], doc: list[str], window: int) -> dict[str, int]:
    """Counts of near pairs per first query word, as the reference's scan tests them.

    The scan first fills a window of 2w + 1 words and tests document places 0 .. w - 2; it then
    slides word by word and tests places w .. n - w - 2. Place w - 1 and the last w + 1 places
    are never tested, and a repeated query word keeps its last successor.
    """
    follows = dict(zip(query, query[1:], strict=False))
    n, counts = len(doc), {}
    places = [*range(min(window - 1, n)), *range(window, n - window - 1)]
    for i in places:
        word = doc[i]
        if word in follows and follows[word] in doc[max(0, i - window) : i + window + 1]:
            counts[word] = counts.get(word, 0) + 1
    return counts


def sdm_unordered(query: list[str], doc: list[str], window: int = 8) -> float:
    """Sum of logarithms over distinct first query words; a count of 0 is taken as 1."""
    counts = unordered_pairs(query, doc, window)
    return sum(math.log((counts.get(w) or 1) + 1) - math.log(len(doc) + 1) for w in dict.fromkeys(query[:-1]))


def with_sdm(pairs: DataFrame, window: int = 8, weights=(0.5, 0.2, 0.3)) -> DataFrame:
    """Pairs (query_id, doc_id, independent, ordered, qw, w: word arrays) with unordered and sdm."""
    a, b, c = weights

    def run(batches):
        for p in batches:
            p["unordered"] = [sdm_unordered(list(q), list(d), window) for q, d in zip(p.qw, p.w, strict=True)]
            p["sdm"] = a * p.independent + b * p.ordered + c * p.unordered
            yield p[["query_id", "doc_id", "unordered", "sdm"]]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select("query_id", "doc_id", "independent", "ordered", "qw", "w").mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, unordered double, sdm double")
