"""Trees that wait for few jobs, large models in batches, pairs in blocks, statistics of features."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklode.operators import boosting, ltr, trees


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = []
    for q in range(30):
        for d in range(12):
            f = [r.random(), r.random(), r.choice((0.0, 1.0))]
            data.append((q, d, float(min(2, int(3 * f[0] * f[2] + 0.3 * r.random()))), f))
    return spark.createDataFrame(data, "query_id long, doc_id long, grade double, feats array<double>").repartition(4).cache()


def plain_tree(x, y, edges, leaves):
    """Leaf by leaf, each split found by trying all thresholds: predictions of the rows."""
    groups, stuck = [np.arange(len(y))], set()
    deviance = lambda g: ((y[g] - y[g].mean()) ** 2).sum()
    while len(groups) < leaves:
        open_ = [k for k in range(len(groups)) if k not in stuck]
        if not open_:
            break
        at = max(open_, key=lambda k: (round(deviance(groups[k]), 9), -k))
        g, best = groups[at], None
        for f, e in enumerate(edges):
            for b in e:
                left = g[x[g, f] <= b]
                if 0 < len(left) < len(g):
                    right = np.setdiff1d(g, left)
                    gain = deviance(g) - deviance(left) - deviance(right)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left, right)
        if best is None:
            stuck.add(at)
            continue
        groups[at] = best[1]
        groups.append(best[2])
    out = np.zeros(len(y))
    for g in groups:
        out[g] = y[g].mean()
    return out


def test_trees_by_waves(spark, rows, monkeypatch):
    """The same trees as leaf by leaf, in fewer aggregates than splits."""
    calls, plain = [], trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda *a: calls.append(1) or plain(*a))
    edges = trees.thresholds(rows, 20)
    made = trees.binned(rows, edges).withColumn("y", F.col("grade")).cache()
    tree = trees.outer(trees.grown(made, edges, 12), edges)
    assert len(calls) <= 8
    got = rows.select("feats", "grade", ltr.tree_score([{"tree": tree}]).alias("s")).collect()
    want = plain_tree(np.array([x.feats for x in got]), np.array([x.grade for x in got]), edges, 12)
    assert np.allclose([x.s for x in got], want, atol=1e-9)
    assert trees.grown(made.limit(0), edges, 4)["value"] == 0.0


def test_whole_boosted_model(spark, rows):
    """Least-squares boosting against the plain counterpart, tree after tree."""
    edges = trees.thresholds(rows, 16)
    model = trees.mart(rows, 4, 5, 0.3, n_thresholds=16)
    got = rows.select("feats", "grade", ltr.tree_score(model).alias("s")).collect()
    x, y = np.array([g.feats for g in got]), np.array([g.grade for g in got])
    score = np.zeros(len(y))
    for _ in range(4):
        score += 0.3 * plain_tree(x, y - score, edges, 5)
    assert np.allclose([g.s for g in got], score, atol=1e-9)


def test_validation_scores_are_carried(spark, rows):
    train, valid = trees.held_out(rows, 0.4)
    model = trees.lambda_mart(train, 6, 4, 0.2, valid=valid, n_thresholds=16)
    whole = trees.lambda_mart(train, 6, 4, 0.2, n_thresholds=16)
    assert model == whole[: len(model)]
    by = [ltr.mean_ndcg(valid, [ltr.tree_score(whole[: k + 1])], 10)[0] for k in range(6)]
    assert len(model) == int(np.argmax(np.round(by, 8))) + 1


def test_large_models_in_batches(spark, rows, monkeypatch):
    model = trees.mart(rows, 3, 6, 0.5, n_thresholds=16)
    plain = {(r.query_id, r.doc_id): r.score for r in ltr.with_tree_score(rows, model).collect()}
    monkeypatch.setattr(ltr, "MOST_NODES", 1)
    got = ltr.with_tree_score(rows, model)
    assert got.columns == [*rows.columns, "score"] and "MapInArrow" in got._jdf.queryExecution().toString()
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == pytest.approx(plain, abs=1e-12)


@pytest.mark.parametrize("kind", ["ranknet", "lambdarank"])
def test_pairs_in_blocks(kind, monkeypatch):
    r = np.random.default_rng(4)
    s, g = r.normal(size=50), r.integers(0, 3, 50).astype(float)
    whole = boosting._pairwise(kind, s, g, 5)
    for pairs in (1, 130, 2500):
        monkeypatch.setattr(boosting, "PAIRS", pairs)
        d, loss = boosting._pairwise(kind, s, g, 5)
        assert np.allclose(d, whole[0]) and abs(loss - whole[1]) < 1e-9
    assert abs(whole[0].sum()) < 1e-9 and boosting._pairwise(kind, s[:0], g[:0], 5)[1] == 0.0


def test_feature_statistics(spark, rows):
    got = {r.feature: r for r in ltr.feature_statistics(rows).collect()}
    x = np.array([r.feats for r in rows.collect()])
    for k in range(3):
        r = got[k + 1]
        assert (r.n, r.least, r.most) == (len(x), x[:, k].min(), x[:, k].max())
        assert np.allclose((r["mean"], r["median"], r["variance"]), (x[:, k].mean(), np.median(x[:, k]), x[:, k].var(ddof=1)))
