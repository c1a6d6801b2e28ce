"""Connected components of a graph given as rows of edges, and of small graphs in arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.session import cut, forget


def local(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of each node's component, by hooking and jumping over whole arrays."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        ok = a != b
        if not ok.any():
            break
        u, v, a, b = u[ok], v[ok], a[ok], b[ok]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node reached) for the nodes of edges (u, v).

    Large-star and small-star steps in turn until every edge leads to its component's least
    node; their number grows with the logarithm of the longest path. Each turn is written to
    the shared folder, in place of the one before. A node's neighbours are only ever reduced to their least one, so hubs
    are combined before the shuffle.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")).select("_u", F.least("m", "_u").alias("m"))
        large = both.join(least, F.col("u") == F.col("_u")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("_u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        last, e = e, cut(small.filter("u <> v").distinct(), "edges")
        forget(last)
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops.select("node", F.col("node").alias("comp")))
