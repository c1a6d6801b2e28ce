"""User-supplied scorers, and how passage and vector scores become document scores.

A scorer is a Python function over batches: (query texts, document texts, or any columns) to
scores. It runs in an iterator Arrow UDF, loaded once a task. Pretrained networks aren't part of
the library; their aggregation is, as expressions over score or vector arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklode.functions import vectors as V
from ranklode.functions.text import col

SCORERS: dict[str, Callable[[], Callable[..., list[float]]]] = {}


def register(name: str):
    """Register a factory: called once a task, it gives the function that scores batches."""

    def add(factory):
        SCORERS[name] = factory
        return factory

    return add


@register("overlap")
def _overlap():
    """An example: the share of the query's words that the document has."""

    def score(queries, docs):
        return [len(set(q.lower().split()) & set(d.lower().split())) / max(1, len(set(q.lower().split()))) for q, d in zip(queries, docs, strict=True)]

    return score


def scored(name: str, *columns) -> Column:
    factory = SCORERS[name]

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        score = factory()
        for b in batches:
            yield pd.Series([float(x) for x in score(*(s.tolist() for s in b))])

    return run(*map(col, columns))


def fused(score, candidate, weight: float) -> Column:
    """Model score plus weighted retrieval score."""
    return col(score) + weight * col(candidate)


def max_passage(scores) -> Column:
    return F.array_max(col(scores))


def sum_passage(scores) -> Column:
    return F.aggregate(col(scores), F.lit(0.0), lambda s, x: s + x)


def mean_passage(scores) -> Column:
    return sum_passage(scores) / F.greatest(F.size(col(scores)), F.lit(1))


def _over_dims(vectors, f) -> Column:
    v = col(vectors)
    return F.transform(F.sequence(F.lit(0), F.size(v[0]) - 1), lambda k: f(F.transform(v, lambda x: x[k].cast("double"))))


def mean_vectors(vectors) -> Column:
    return _over_dims(vectors, lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def max_vectors(vectors) -> Column:
    """Greatest components; of zeros of both signs the last one counts, as in SQL's ``list_max``."""
    return _over_dims(vectors, lambda a: F.array_max(F.reverse(a)))


def attention(vectors, probe) -> Column:
    """Sum of vectors weighted by the softmax of their products with a probe vector."""
    let = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a value that is worked out once a row
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    zero = F.transform(V.dense(col(vectors)[0]), lambda _: F.lit(0.0))
    weighted = lambda e: F.aggregate(F.zip_with(col(vectors), e, lambda v, w: F.transform(V.dense(v), lambda x: x * w)), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    raw = F.transform(col(vectors), lambda v: V.dot(v, col(probe)))
    weights = let(raw, lambda r: let(F.array_max(r), lambda top: F.transform(r, lambda x: F.exp(x - top))))
    return let(weights, lambda e: let(total(e), lambda n: F.transform(weighted(e), lambda x: x / n)))


def late_interaction(query_vectors, doc_vectors) -> Column:
    """For each query vector the greatest product with a document vector, summed."""
    best = F.transform(col(query_vectors), lambda q: F.array_max(F.transform(col(doc_vectors), lambda d: V.dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def passages(docs: DataFrame, words: str, size: int, stride: int) -> DataFrame:
    """doc_id, passage, w: windows over long documents."""
    n = (F.ceil(F.greatest(F.size(words) - size, F.lit(0)) / stride) + 1).cast("int")
    return docs.withColumn("passage", F.explode(F.sequence(F.lit(0), n - 1))).select("doc_id", "passage", F.slice(words, F.col("passage") * stride + 1, F.lit(size)).alias("w"))


def reranked(run: DataFrame, score: Column, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return run.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
