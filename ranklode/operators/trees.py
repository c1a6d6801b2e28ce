"""Regression trees grown by leaves from histograms, and the rankers made of them.

Feature values become numbers of threshold bins once. A tree grows by splitting the leaf of
greatest deviance at the threshold that explains most of it. Where a leaf would be split doesn't depend on
the others, so one aggregate gives the sums for the children of all leaves that wait (of
the smaller child alone; the other is what is left of the parent): about one a level of the tree, not
one a split. Only histograms (features x thresholds) are on the driver; rows stay where they are. Trees have the
form that ``ltr.tree_score`` takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklode.operators import ltr
from ranklode.operators.sampling import uniform
from ranklode.session import cut, forget

THRESHOLDS = 256


def thresholds(df: DataFrame, n: int = THRESHOLDS) -> list[np.ndarray]:
    """Of each feature its distinct values, or n evenly spaced ones where it has more; the last
    bin is open."""
    size = df.select(F.max(F.size("feats"))).first()[0]
    x = df.select(F.posexplode("feats").alias("f", "x"))
    span = {r.f: (r.lo, r.hi, r.n) for r in x.groupBy("f").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.approx_count_distinct("x", 0.02).alias("n")).collect()}
    few = [f for f, (_, _, m) in span.items() if m <= n]
    values: dict[int, list[float]] = {}
    for r in x.filter(F.col("f").isin(few)).distinct().collect() if few else []:
        values.setdefault(r.f, []).append(r.x)
    return [np.array(sorted(values[f])) if f in values and len(values[f]) <= n else np.linspace(*span[f][:2], n) for f in range(size)]


def binned(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Rows with ``bins``: for each feature the first threshold at or above the value."""

    def run(batches):
        for b in batches:
            feats = np.array(b.column("feats").to_pylist(), float).reshape(b.num_rows, -1)
            out = np.stack([np.minimum(np.searchsorted(e, feats[:, f]), len(e)) for f, e in enumerate(edges)], 1).astype(np.int32) if b.num_rows else feats.astype(np.int32)
            yield b.append_column("bins", pa.array(out.tolist(), pa.list_(pa.int32())))

    return df.mapInArrow(run, df.schema.simpleString()[7:-1] + ", bins array<int>")


def _leaf(node: dict) -> Column:
    if "leaf" in node:
        return F.lit(node["leaf"])
    return F.when(F.col("bins")[node["f"]] <= node["bin"], _leaf(node["left"])).otherwise(_leaf(node["right"]))


def _histograms(rows: DataFrame, key: Column, sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each key, counts and sums of y by feature and bin, and the sum of squares; rows without key count for none."""
    x = rows.select(key.alias("_key"), "bins", "y").filter("_key is not null").select("_key", F.posexplode("bins").alias("f", "b"), "y")
    out: dict[int, list] = {}
    for r in x.groupBy("_key", "f", "b").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).collect():
        h = out.setdefault(r["_key"], [np.zeros((len(sizes), max(sizes))), np.zeros((len(sizes), max(sizes))), 0.0])
        h[0][r.f, r.b], h[1][r.f, r.b] = r.n, r.s
        h[2] += r.q if r.f == 0 else 0.0
    return {k: tuple(h) for k, h in out.items()}


def _best(h, edges, least: int, allowed) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split, or none."""
    n, s, _ = h
    cn, cs = np.cumsum(n, 1), np.cumsum(s, 1)
    total_n, total_s = cn[0, -1], cs[0, -1]
    best = None
    for f in allowed:
        m = len(edges[f])  # the open bin can't be left of a split
        left_n, left_s = cn[f, :m], cs[f, :m]
        right_n, right_s = total_n - left_n, total_s - left_s
        ok = (left_n >= least) & (right_n >= least)
        if ok.any():
            gain = np.where(ok, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - total_s**2 / max(total_n, 1), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-12 and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), f, k)
    return best


def grown(rows: DataFrame, edges: list[np.ndarray], leaves: int = 10, least: int = 1, allowed: list[int] | None = None) -> dict:
    """A tree over rows (bins, y), inner form: nodes have f, bin, left, right, or leaf (a number)
    and value (the mean of y)."""
    sizes = [len(e) + 1 for e in edges]
    allowed = range(len(edges)) if allowed is None else allowed
    root = {"leaf": 0}

    def mean(h):
        return float(h[1][0].sum() / max(h[0][0].sum(), 1))

    def deviance(h):
        return h[2] - h[1][0].sum() ** 2 / max(h[0][0].sum(), 1)

    none = (np.zeros((len(sizes), max(sizes))), np.zeros((len(sizes), max(sizes))), 0.0)
    state = {0: (root, _histograms(rows, F.lit(0), sizes).get(0, none))}
    root["value"] = mean(state[0][1])
    split: dict[int, tuple | None] = {}  # of a leaf: gain, feature, bin
    ready: dict[int, tuple] = {}  # of a leaf: its children's histograms
    while len(state) < leaves:
        for k, (_, h) in state.items():
            if k not in split:
                split[k] = _best(h, edges, least, allowed)
        at = max((k for k in state if split[k]), key=lambda k: (deviance(state[k][1]), -k), default=None)
        if at is None:
            break
        if at not in ready:
            leaf, key, small_left = _leaf(root), F.lit(None).cast("int"), {}
            for k in (k for k in state if split[k] and k not in ready):
                _, f, b = split[k]
                h = state[k][1]
                small_left[k] = h[0][f, : b + 1].sum() <= h[0][f, b + 1 :].sum()
                side = F.col("bins")[f] <= b if small_left[k] else F.col("bins")[f] > b
                key = F.when((leaf == k) & side, k).otherwise(key)
            found = _histograms(rows, key, sizes)
            for k, is_left in small_left.items():
                one = found.get(k, none)
                other = tuple(x - y for x, y in zip(state[k][1], one, strict=True))
                ready[k] = (one, other) if is_left else (other, one)
        (_, f, b), (left, right), node, new = split.pop(at), ready.pop(at), state[at][0], max(state) + 1
        node.pop("leaf"), node.pop("value")
        node |= {"f": f, "bin": b, "left": {"leaf": at, "value": mean(left)}, "right": {"leaf": new, "value": mean(right)}}
        state[at], state[new] = (node["left"], left), (node["right"], right)
    return root


def _set_values(node: dict, values: dict[int, float]) -> None:
    if "leaf" in node:
        node["value"] = values.get(node["leaf"], node["value"])
    else:
        _set_values(node["left"], values)
        _set_values(node["right"], values)


def outer(node: dict, edges: list[np.ndarray]) -> dict:
    """The form of ``ltr.tree_score``: features from 1, thresholds instead of bins."""
    if "leaf" in node:
        return {"value": node["value"]}
    return {"feature": node["f"] + 1, "threshold": float(edges[node["f"]][node["bin"]]), "left": outer(node["left"], edges), "right": outer(node["right"], edges)}


def _value(node: dict) -> Column:
    if "leaf" in node:
        return F.lit(float(node["value"]))
    return F.when(F.col("bins")[node["f"]] <= node["bin"], _value(node["left"])).otherwise(_value(node["right"]))


def _prepared(df: DataFrame, n: int):
    edges = thresholds(df, n)
    rows = binned(df.select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"), F.col("feats").cast("array<double>").alias("feats")), edges)
    return cut(rows.select("query_id", "doc_id", "grade", "bins", F.lit(0.0).alias("score")), "ltr"), edges


def lambda_mart(df: DataFrame, trees: int = 1000, leaves: int = 10, rate: float = 0.1, k: int = 10, least: int = 1, n_thresholds: int = THRESHOLDS, valid: DataFrame | None = None, patience: int = 100) -> list[dict]:
    """Trees fitted to the gradients of NDCG at k, a leaf's value a Newton step (sum of gradients
    over sum of weights). With validation rows the trees after the best metric go, and training
    ends when it hasn't risen for ``patience`` trees."""
    rows, edges = _prepared(df, n_thresholds)
    model, best, best_at = [], -1.0, 0
    if valid is not None:  # its scores are carried along, too
        held = valid.select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"), F.col("feats").cast("array<double>").alias("feats"))
        held = cut(binned(held, edges).withColumn("score", F.lit(0.0)), "ltr")
    for t in range(trees):
        g = ltr.lambdas(rows, k).select("query_id", "doc_id", F.col("lam").alias("y"), "weight")
        now = cut(rows.join(g, ["query_id", "doc_id"], "left").withColumns({"y": F.coalesce("y", F.lit(0.0)), "weight": F.coalesce("weight", F.lit(0.0))}), "ltr")
        tree = grown(now, edges, leaves, least)
        sums = now.groupBy(_leaf(tree).alias("leaf")).agg(F.sum("y").alias("s"), F.sum("weight").alias("w")).collect()
        _set_values(tree, {r.leaf: r.s / r.w if r.w else 0.0 for r in sums})
        before, rows = rows, cut(now.select("query_id", "doc_id", "grade", "bins", (F.col("score") + rate * _value(tree)).alias("score")), "ltr")
        forget(before, now)
        model.append({"weight": rate, "tree": outer(tree, edges)})
        if valid is not None:
            old, held = held, cut(held.withColumn("score", F.col("score") + rate * _value(tree)), "ltr")
            forget(old)
            value = ltr.mean_ndcg(held, [F.col("score")], k)[0]
            if value > best + 1e-9:
                best, best_at = value, t
            elif t - best_at >= patience:
                break
    return model[: best_at + 1] if valid is not None else model


def mart(df: DataFrame, trees: int = 1000, leaves: int = 10, rate: float = 0.1, least: int = 1, n_thresholds: int = THRESHOLDS) -> list[dict]:
    """Trees fitted to what the trees before leave of the grades."""
    rows, edges = _prepared(df, n_thresholds)
    model = []
    for _ in range(trees):
        tree = grown(rows.withColumn("y", F.col("grade") - F.col("score")), edges, leaves, least)
        before, rows = rows, cut(rows.withColumn("score", F.col("score") + rate * _value(tree)), "ltr")
        forget(before)
        model.append({"weight": rate, "tree": outer(tree, edges)})
    return model


def random_forest(df: DataFrame, bags: int = 300, leaves: int = 100, rate: float = 1.0, feature_rate: float = 0.3, least: int = 1, n_thresholds: int = THRESHOLDS, seed: int = 1) -> list[list[dict]]:
    """One tree a bag, over queries drawn with replacement and a share of the features; the score
    is the mean of the bags."""
    rows, edges = _prepared(df, n_thresholds)
    out = []
    for b in range(bags):
        order = np.random.Generator(np.random.PCG64([seed, b])).permutation(len(edges))
        some = sorted(order[: max(1, round(feature_rate * len(edges)))].tolist())
        drawn = ltr.bag(rows, rate, True, f"{seed}/{b}").withColumn("y", F.col("grade"))
        out.append([{"weight": 1.0, "tree": outer(grown(drawn, edges, leaves, least, some), edges)}])
    return out


def held_out(df: DataFrame, share: float, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, by a hash of the query."""
    u = uniform("query_id", seed)
    return df.filter(u >= share), df.filter(u < share)
