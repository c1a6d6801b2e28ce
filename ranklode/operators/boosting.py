"""AdaRank, RankBoost, and rankers trained by gradients (RankNet, LambdaRank, ListNet).

Nothing pairs documents in a table. RankBoost's weight of a pair is exp(H(worse) - H(better)) for
the ensemble's score H so far, so that a document's potential is two sums over its query, by
grade. Models are lists of numbers on the driver; each round is one or two aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklode.operators import ltr
from ranklode.session import cut, forget


def ada_rank(df: DataFrame, rounds: int = 500, tolerance: float = 0.002, most_in_a_row: int = 5, k: int = 10) -> list[tuple[int, float]]:
    """(feature from 1, weight) of each round. Each round takes the single feature whose ranking
    serves the weighted queries best; queries that the ensemble serves badly gain weight. Ends
    when the mean metric falls by more than the tolerance; a feature that is taken
    ``most_in_a_row`` times without any change is left out until another is taken."""
    df = cut(df.select("query_id", "doc_id", "grade", F.col("feats").cast("array<double>").alias("feats")), "ltr")
    n = df.select(F.max(F.size("feats"))).first()[0]
    weak = cut(ltr.query_ndcg(df, [F.col("feats")[f] for f in range(n)], k), "weak")
    weights = cut(_uniform(weak), "weights")
    model: list[tuple[int, float]] = []
    last, last_feature, in_a_row, out = -1.0, -1, 0, set()
    for _ in range(rounds):
        sums = {r.m: r for r in weak.join(weights, "query_id").groupBy("m").agg(F.sum(F.col("p") * F.col("v")).alias("e"), F.sum(F.col("p") * (1 + F.col("v"))).alias("up"), F.sum(F.col("p") * (1 - F.col("v"))).alias("down")).collect()}
        left = [f for f in sums if f not in out]
        if not left:
            break
        f = max(left, key=lambda x: (round(sums[x].e, 12), -x))
        alpha = 0.5 * math.log(sums[f].up / max(sums[f].down, 1e-12))
        trial = [*model, (f + 1, alpha)]
        score = sum((F.lit(a) * F.col("feats")[g - 1] for g, a in trial), F.lit(0.0))
        per = cut(ltr.query_ndcg(df, [score], k).select("query_id", "v"), "served")
        value, total = per.agg(F.avg("v"), F.sum(F.exp(F.lit(-alpha) * F.col("v")))).first()
        if value + tolerance - last <= 0:
            break
        if value != last:
            in_a_row, out = 0, set()
        elif f == last_feature:
            in_a_row += 1
            if in_a_row == most_in_a_row:
                in_a_row = 0
                out.add(f)
        else:
            in_a_row, out = 0, set()
        model, last, last_feature = trial, value, f
        before, weights = weights, cut(weights.join(per, "query_id").select("query_id", (F.col("p") * F.exp(F.lit(-alpha) * F.col("v")) / total).alias("p")), "weights")
        forget(before, per)
    return model


def _uniform(weak: DataFrame) -> DataFrame:
    queries = weak.filter("m = 0").select("query_id")
    return queries.withColumn("p", F.lit(1.0 / max(queries.count(), 1)))


def rank_boost(df: DataFrame, rounds: int = 300, n_thresholds: int = 10) -> list[tuple[int, float, float]]:
    """(feature from 1, threshold, weight) of each round: a document above the threshold gets the
    weight."""
    rows = cut(df.select("query_id", "doc_id", F.col("grade").cast("double").alias("g"), F.col("feats").cast("array<double>").alias("feats"), F.lit(0.0).alias("h")), "ltr")
    span = rows.select(F.posexplode("feats").alias("f", "x")).groupBy("f").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    # from the greatest value down in even steps, and one below all
    edges = {r.f: [*(r.hi - j * (r.hi - r.lo) / n_thresholds for j in range(n_thresholds)), r.lo - 1e8] for r in span}
    table = F.array(*(F.array(*map(F.lit, edges[f])) for f in sorted(edges)))
    model = []
    for _ in range(rounds):
        q, upto = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("g").rangeBetween(Window.unboundedPreceding, 0)
        x = rows.withColumn("_up", F.exp("h")).withColumn("_down", F.exp(-F.col("h")))
        worse = F.sum("_up").over(upto) - F.sum("_up").over(Window.partitionBy("query_id", "g"))
        better = F.sum("_down").over(q) - F.sum("_down").over(upto)
        x = x.withColumn("_p", F.col("_down") * worse - F.col("_up") * better).withColumn("_z", F.col("_down") * worse)
        # a document counts for the thresholds below its value: sums by the first of them
        first = F.transform("feats", lambda v, f: F.size(F.filter(F.get(table, f), lambda e: e >= v)))
        z = x.agg(F.sum("_z")).first()[0]
        if not z:
            break
        got = x.select(F.posexplode(first).alias("f", "b"), "_p").groupBy("f", "b").agg(F.sum("_p").alias("p")).collect()
        sums = {f: np.zeros(n_thresholds + 2) for f in edges}
        for r in got:
            sums[r.f][r.b] += r.p / z
        best = max(((float(np.cumsum(sums[f])[j]), -f, -j) for f in edges for j in range(n_thresholds + 1)), key=lambda b: (round(b[0], 12), *b[1:]))
        r, f, j = best[0], -best[1], -best[2]
        if r >= 1 - 1e-12 or r <= 0:
            if r > 0:
                model.append((f + 1, edges[f][j], 0.5 * math.log((1 + r) / 1e-12)))
            break
        alpha = 0.5 * math.log((1 + r) / (1 - r))
        model.append((f + 1, edges[f][j], alpha))
        before, rows = rows, cut(rows.withColumn("h", F.col("h") + F.when(F.col("feats")[f] > edges[f][j], alpha).otherwise(0.0)), "ltr")
        forget(before)
    return model


#: Pairs of documents whose gradients are held at once.
PAIRS = 1 << 21


def _pairwise(kind: str, s: np.ndarray, g: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Gradient by scores and loss over a query's pairs of different grades, some rows of pairs at a time."""
    n, step = len(s), max(1, PAIRS // max(len(s), 1))
    if kind == "lambdarank":
        place = np.empty(n)
        place[np.argsort(-s, kind="stable")] = np.arange(1, n + 1)
        disc = np.where(place <= k, 1 / np.log2(place + 1), 0.0)
        ideal = max((np.sort(2.0**g - 1)[::-1][:k] / np.log2(np.arange(2, min(n, k) + 2))).sum(), 1e-12)
    d, loss = np.zeros(n), 0.0
    for i in range(0, n, step):
        j = slice(i, i + step)
        rho = np.where(g[j, None] > g, 1 / (1 + np.exp(np.clip(s[j, None] - s, -500, 500))), 0.0)
        if kind == "lambdarank":
            rho *= np.abs((2.0 ** g[j, None] - 2.0**g) * (disc[j, None] - disc)) / ideal
        d += rho.sum(0)
        d[j] -= rho.sum(1)
        loss += float(rho.sum())
    return d, loss


def _gradient(kind: str, w: list[np.ndarray], x: np.ndarray, g: np.ndarray, k: int) -> tuple[list[np.ndarray], float]:
    """Gradient of one query's loss and the loss."""
    hidden = 1 / (1 + np.exp(-(x @ w[0] + w[1]))) if len(w) > 1 else None
    s = hidden @ w[2] + w[3][0] if len(w) > 1 else x @ w[0][:, 0]
    if kind == "listnet":
        p, q = (np.exp(v - v.max()) / np.exp(v - v.max()).sum() for v in (g, s))
        d, loss = q - p, float(-(p * np.log(np.maximum(q, 1e-300))).sum())
    else:
        d, loss = _pairwise(kind, s, g, k)
    if len(w) == 1:
        return [(x.T @ d)[:, None]], loss
    back = (d[:, None] * w[2][None, :]) * hidden * (1 - hidden)
    return [x.T @ back, back.sum(0), hidden.T @ d, np.array([d.sum()])], loss


def _step(kind: str, w: list[np.ndarray], k: int):
    def one(key, table):
        x, g = np.array(table.column("feats").to_pylist(), float), table.column("g").to_numpy()
        got, _ = _gradient(kind, w, x, g, k)
        return pa.table([pa.array([np.concatenate([v.ravel() for v in got]).tolist()], pa.list_(pa.float64()))], names=["d"])

    return one


def neural(df: DataFrame, kind: str, epochs: int = 100, rate: float = 0.005, hidden: int = 10, k: int = 10, seed: int = 1) -> list[np.ndarray]:
    """Weights of 'ranknet', 'lambdarank' (one hidden layer) or 'listnet' (linear) after full-batch
    steps; a query's gradient comes from its own documents, and their sum from one aggregate."""
    if kind not in ("ranknet", "lambdarank", "listnet"):
        raise ValueError(f"unknown kind {kind}")
    rows = cut(df.select("query_id", F.col("grade").cast("double").alias("g"), F.col("feats").cast("array<double>").alias("feats")), "ltr")
    n = rows.select(F.max(F.size("feats"))).first()[0]
    r = np.random.Generator(np.random.PCG64(seed))
    w = [np.zeros((n, 1))] if kind == "listnet" else [r.normal(0, 0.5, (n, hidden)), np.zeros(hidden), r.normal(0, 0.5, hidden), np.zeros(1)]
    for _ in range(epochs):
        d = rows.groupBy("query_id").applyInArrow(_step(kind, w, k), "d array<double>").select(F.posexplode("d").alias("i", "d")).groupBy("i").agg(F.avg("d").alias("d")).collect()
        flat = np.array([v.d for v in sorted(d, key=lambda v: v.i)])
        at = np.cumsum([0, *(v.size for v in w)])
        w = [v - rate * flat[a:b].reshape(v.shape) for v, a, b in zip(w, at, at[1:], strict=False)]
    return w


def neural_score(w: list[np.ndarray], feats="feats"):
    """The score of such weights as an expression."""
    f = F.col(feats)
    if len(w) == 1:
        return ltr.linear(w[0][:, 0].tolist(), feats)
    total = F.lit(float(w[3][0]))
    for j in range(len(w[1])):
        total = total + F.lit(float(w[2][j])) / (1 + F.exp(-(ltr.linear(w[0][:, j].tolist(), f) + F.lit(float(w[1][j])))))
    return total
