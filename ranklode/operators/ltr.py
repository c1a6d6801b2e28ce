"""Learning to rank on feature rows (query_id, doc_id, grade, feats: array of doubles).

Models are small and live on the driver; what is computed from the rows is always one
distributed aggregate. A trainer that probes many models scores all probes of a round in one
plan, exploding a bounded list of weight vectors, instead of one job a probe.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklode.operators.sampling import folds, uniform
from ranklode.session import cut


def linear(weights: list[float], feats="feats") -> Column:
    """Dot product; another number of features, or NaN, is an error."""
    f = F.col(feats) if isinstance(feats, str) else feats
    total = F.aggregate(F.zip_with(f, F.array(*map(F.lit, map(float, weights))), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    bad = (F.size(f) != len(weights)) | F.isnan(total)
    return F.when(bad, F.raise_error(F.lit("features don't fit the model")).cast("double")).otherwise(total)


def reranked(df: DataFrame, score: Column, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return df.select("query_id", "doc_id", F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def feature_statistics(df: DataFrame) -> DataFrame:
    """feature (from 1), n, least, most, mean, median, variance of the features of rows (feats). Medians
    are exact, by brackets; there is a pass for each feature."""
    from ranklode.operators.sampling import quantiles

    long = df.select(F.posexplode("feats").alias("k", "x"))
    per = long.groupBy("k").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    features = df.agg(F.max(F.size("feats"))).first()[0] or 0
    middle = [(k, quantiles(df.select(F.col("feats")[k].alias("x")), "x", (0.5,)).first().value) for k in range(features)]
    middle = df.sparkSession.createDataFrame(middle, "k int, median double")
    return per.join(F.broadcast(middle), "k").select((F.col("k") + 1).alias("feature"), "n", "least", "most", "mean", "median", "variance")


#: Trees of so many nodes at most are scored by one expression, larger models in Arrow batches.
MOST_NODES = 1_000


def _flat(tree: dict) -> list[np.ndarray]:
    """Feature (from 0, -1 at leaves), threshold or value, left and right of each node."""
    rows: list[list] = []

    def walk(n: dict) -> int:
        at = len(rows)
        rows.append([-1, float(n["value"]), 0, 0] if "value" in n else [n["feature"] - 1, float(n["threshold"]), 0, 0])
        if "value" not in n:
            rows[at][2], rows[at][3] = walk(n["left"]), walk(n["right"])
        return at

    walk(tree)
    return [np.array(c) for c in zip(*rows, strict=True)]


def with_tree_score(df: DataFrame, model: list[dict], name: str = "score") -> DataFrame:
    """Rows (feats, ...) with the model's score, however many trees it has."""
    flat = [(float(t.get("weight", 1.0)), *_flat(t["tree"])) for t in model]
    if sum(len(f[1]) for f in flat) <= MOST_NODES:
        return df.withColumn(name, tree_score(model))
    at = df.columns.index("feats")

    def run(batches):
        for b in batches:
            x = np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, -1)
            total, every = np.zeros(b.num_rows), np.arange(b.num_rows)
            for weight, feature, value, left, right in flat:
                node = np.zeros(b.num_rows, int)
                while (inner := feature[node] >= 0).any():
                    go = every[inner]
                    n = node[go]
                    node[go] = np.where(x[go, feature[n]] <= value[n], left[n], right[n])
                total += weight * value[node]
            yield b.append_column(name, pa.array(total))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def tree_score(model: list[dict], feats="feats") -> Column:
    """Sum of weighted trees as one conditional expression. A tree is {'feature', 'threshold',
    'left', 'right'} or {'value'}; feature ids count from 1; left is at or below the threshold."""

    def walk(n: dict) -> Column:
        if "value" in n:
            return F.lit(float(n["value"]))
        return F.when(F.col(feats)[n["feature"] - 1] <= n["threshold"], walk(n["left"])).otherwise(walk(n["right"]))

    total = F.lit(0.0)
    for tree in model:
        total = total + F.lit(float(tree.get("weight", 1.0))) * walk(tree["tree"])
    return total


def normalized(df: DataFrame, how: str) -> DataFrame:
    """Each feature scaled within its query: 'sum', 'zscore' or 'linear'."""
    long = df.select("query_id", "doc_id", "grade", F.posexplode("feats").alias("k", "x"))
    w = Window.partitionBy("query_id", "k")
    x = F.col("x")
    if how == "sum":
        total = F.sum(F.abs("x")).over(w)
        y = F.when(total > 0, x / total).otherwise(x)
    elif how == "zscore":
        sd = F.stddev_samp("x").over(w)
        y = F.when(sd > 0, (x - F.avg("x").over(w)) / sd).otherwise(x)
    elif how == "linear":
        lo, hi = F.min("x").over(w), F.max("x").over(w)
        y = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)
    else:
        raise ValueError(f"unknown normaliser {how}")
    return long.withColumn("x", y).groupBy("query_id", "doc_id", "grade").agg(F.sort_array(F.collect_list(F.struct("k", "x")))["x"].alias("feats"))


def linear_regression(df: DataFrame, l2: float = 1e-10) -> list[float]:
    """Least squares with intercept (last weight): normal equations from one aggregate."""
    n = df.select(F.max(F.size("feats"))).first()[0] + 1
    x = F.concat("feats", F.array(F.lit(1.0)))
    sums = [F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(x[i] * F.col("grade")) for i in range(n)]
    got = list(df.agg(*sums).first())
    a = np.zeros((n, n))
    for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i, n)):
        a[i, j] = a[j, i] = got[k]
    return np.linalg.solve(a + l2 * np.eye(n), np.array(got[-n:])).tolist()


def query_ndcg(df: DataFrame, scores: list[Column], k: int) -> DataFrame:
    """m, query_id, v: NDCG at k (exponential gain, ideal of the retrieved) of each query by each
    of a bounded list of scores, in one plan."""
    x = df.select("query_id", "doc_id", F.col("grade").cast("double").alias("g"), F.posexplode(F.array(*(s.cast("double") for s in scores))).alias("m", "s"))
    q = Window.partitionBy("m", "query_id")
    x = x.withColumn("i", F.row_number().over(q.orderBy(F.desc(F.round("s", 9)), F.desc("doc_id")))).withColumn("j", F.row_number().over(q.orderBy(F.desc("g"), F.desc("doc_id"))))
    gain = F.pow(F.lit(2.0), F.col("g")) - 1
    part = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1)).otherwise(0.0))
    per = x.groupBy("m", "query_id").agg(part("i").alias("d"), part("j").alias("z"))
    return per.select("m", "query_id", F.when(F.col("z") > 0, F.col("d") / F.col("z")).otherwise(0.0).alias("v"))


def mean_ndcg(df: DataFrame, scores: list[Column], k: int) -> list[float]:
    got = query_ndcg(df, scores, k).groupBy("m").agg(F.avg("v").alias("v")).collect()
    return [r.v for r in sorted(got, key=lambda r: r.m)]


def _mean_metric(df: DataFrame, probes: list[list[float]], k: int) -> list[float]:
    return mean_ndcg(df, [F.aggregate(F.zip_with("feats", F.array(*map(F.lit, map(float, p))), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) for p in probes], k)


def coordinate_ascent(df: DataFrame, k: int = 10, restarts: int = 2, iterations: int = 5, step: float = 0.05, scale: float = 2.0, tolerance: float = 0.001, levels: int = 6, seed: int = 1) -> tuple[list[float], float]:
    """Weights and their metric. For one coordinate after another all steps of both signs, and
    zero, are tried at once; weights are scaled to sum 1 after each success."""
    df = cut(df.select("query_id", "doc_id", "grade", "feats"), "ltr")
    n = df.select(F.max(F.size("feats"))).first()[0]
    best, best_value, r = [1.0 / n] * n, -1.0, random.Random(seed)
    for start in range(restarts):
        w = [1.0 / n] * n if not start else [r.random() for _ in range(n)]
        value = _mean_metric(df, [w], k)[0]
        for _ in range(iterations):
            before = value
            for c in r.sample(range(n), n):
                base = abs(w[c]) or 1.0
                steps = [sign * step * base * scale**e for e in range(levels) for sign in (1, -1)] + [-w[c]]
                probes = [[x + (d if i == c else 0.0) for i, x in enumerate(w)] for d in steps]
                scores = _mean_metric(df, probes, k)
                at = int(np.argmax(scores))
                if scores[at] > value + 1e-9:
                    total = sum(map(abs, probes[at])) or 1.0
                    w, value = [x / total for x in probes[at]], scores[at]
            if value - before < tolerance:
                break
        if value > best_value:
            best, best_value = w, value
    return best, best_value


def lambdas(df: DataFrame, k: int = 10) -> DataFrame:
    """lam, weight of each row (query_id, doc_id, grade, score): gradients of pairs of different
    grade, times the change of NDCG at k if the two changed places. Pairs form within a query's
    ranked list only."""
    w = Window.partitionBy("query_id")
    x = df.withColumn("i", F.row_number().over(w.orderBy(F.desc("score"), F.desc("doc_id")))).withColumn("j", F.row_number().over(w.orderBy(F.desc("grade"), F.desc("doc_id"))))
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    disc = lambda i: F.when(i <= k, 1 / F.log2(i + 1)).otherwise(0.0)
    x = x.withColumn("z", F.sum(gain(F.col("grade")) * disc(F.col("j"))).over(w))
    a = x.select("query_id", "doc_id", "grade", "score", "i", "z")
    b = x.select("query_id", *(F.col(c).alias(f"_{c}") for c in ("grade", "score", "i")))
    p = a.join(b, "query_id").filter(F.col("grade") != F.col("_grade"))
    delta = F.abs((gain(F.col("grade")) - gain(F.col("_grade"))) * (disc(F.col("i")) - disc(F.col("_i")))) / F.greatest("z", F.lit(1e-12))
    up = F.col("grade") > F.col("_grade")
    rho = 1 / (1 + F.exp(F.when(up, F.col("score") - F.col("_score")).otherwise(F.col("_score") - F.col("score"))))
    return p.groupBy("query_id", "doc_id").agg(F.sum(F.when(up, rho * delta).otherwise(-rho * delta)).alias("lam"), F.sum(rho * (1 - rho) * delta).alias("weight"))


def lambda_mart(df: DataFrame, trees: int = 1000, **how) -> list[dict]:
    """Trees fitted to the gradients of NDCG (``trees.lambda_mart``); ``boosted_score`` ranks by them."""
    from ranklode.operators import trees as grown  # that module takes its gradients from this one

    return grown.lambda_mart(df, trees, **how)


def boosted_score(df: DataFrame, model: list[dict]) -> DataFrame:
    return df.withColumn("score", tree_score(model))


def bag(df: DataFrame, rate: float, replace: bool, seed: str = "0") -> DataFrame:
    """Queries drawn for one bag; with replacement a query comes as often as its hash says
    (Poisson by inversion)."""
    if not replace:
        return df.filter(uniform("query_id", seed) < rate)
    u, p, total, n = uniform("query_id", seed), float(np.exp(-rate)), 0.0, F.lit(0)
    for c in range(8):
        total += p
        n = n + (u >= total).cast("int")
        p *= rate / (c + 1)
    return df.withColumn("_n", n).filter("_n > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_c")


def cross_validation(df: DataFrame, n: int):
    """(train, test) of each fold: contiguous queries, the remainder to the last."""
    f = folds(df.select("query_id").distinct(), n)
    x = df.join(f, "query_id")
    for k in range(n):
        yield x.filter(F.col("fold") != k).drop("fold"), x.filter(F.col("fold") == k).drop("fold")


def feature_use(models: list[list[dict]]) -> dict[int, int]:
    """How often each feature splits a node of tree models."""
    out: dict[int, int] = {}

    def walk(n):
        if "value" not in n:
            out[n["feature"]] = out.get(n["feature"], 0) + 1
            walk(n["left"])
            walk(n["right"])

    for m in models:
        for tree in m:
            walk(tree["tree"])
    return out

