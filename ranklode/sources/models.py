"""Model files of rankers: reading, writing, scoring, and one entry to the trainers.

A file's first line names the kind; other lines that start with ## are notes. Linear models are
``feature:weight`` pairs (feature 0 is added to the score), boosted thresholds
``feature:threshold:weight`` triples, tree models XML: one <ensemble> of weighted <tree>s, or
several whose mean is the score. A model is small and becomes one expression.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklode.operators import boosting, ltr, trees

# Names of model kinds in files, in the order of their numbers from 0.
KINDS = ("MART", "RankNet", "RankBoost", "AdaRank", "Coordinate Ascent", "LambdaRank", "LambdaMART", "ListNet", "Random Forests", "Linear Regression")
# End of fixed values.
LINEAR, STEPS, TREES = ("AdaRank", "Coordinate Ascent", "Linear Regression"), ("RankBoost",), ("MART", "LambdaMART", "Random Forests")


@dataclass
class Model:
    kind: str
    body: list  # linear: (feature, weight); steps: (feature, threshold, weight); trees: ensembles

    def score(self, feats="feats") -> Column:
        f = F.col(feats) if isinstance(feats, str) else feats
        total = F.lit(0.0)
        if self.kind in LINEAR:
            for k, w in self.body:
                total = total + (F.lit(float(w)) if k == 0 else F.lit(float(w)) * f[k - 1])
            return total
        if self.kind in STEPS:
            for k, threshold, w in self.body:
                total = total + F.when(f[k - 1] > threshold, float(w)).otherwise(0.0)
            return total
        for ensemble in self.body:
            total = total + ltr.tree_score(ensemble, feats)
        return total / max(len(self.body), 1)

    def text(self) -> str:
        head = f"## {self.kind}\n"
        if self.kind in TREES:
            return head + "\n" + "\n".join(map(_ensemble, self.body))
        return head + " ".join(":".join(str(x) for x in part) for part in self.body) + "\n"


def _split(node: dict, indent: str) -> str:
    if "value" in node:
        return f"{indent}<output> {node['value']} </output>\n"
    out = f"{indent}<feature> {node['feature']} </feature>\n{indent}<threshold> {node['threshold']} </threshold>\n"
    for side in ("left", "right"):
        out += f'{indent}<split pos="{side}">\n{_split(node[side], indent + chr(9))}{indent}</split>\n'
    return out


def _ensemble(model: list[dict]) -> str:
    out = "<ensemble>\n"
    for k, tree in enumerate(model, 1):
        out += f'\t<tree id="{k}" weight="{tree.get("weight", 1.0)}">\n\t\t<split>\n{_split(tree["tree"], chr(9) * 3)}\t\t</split>\n\t</tree>\n'
    return out + "</ensemble>\n"


def _node(e: ET.Element) -> dict:
    if e.find("output") is not None:
        return {"value": float(e.find("output").text)}
    sides = {s.get("pos"): _node(s) for s in e.findall("split")}
    return {"feature": int(e.find("feature").text), "threshold": float(e.find("threshold").text), **sides}


def parse(text: str) -> Model:
    """A model of a file's text; an unknown first line is an error."""
    first, _, rest = text.strip().partition("\n")
    names = {k.upper(): k for k in KINDS}
    kind = names.get(first.lstrip("# ").strip().upper())
    if kind is None:
        raise ValueError(f"unknown model kind: {first[:80]}")
    rest = "\n".join(x for x in rest.splitlines() if not x.startswith("##"))
    if kind in TREES:
        roots = ET.fromstring(f"<models>{rest}</models>").findall("ensemble")
        return Model(kind, [[{"weight": float(t.get("weight")), "tree": _node(t.find("split"))} for t in e.findall("tree")] for e in roots])
    parts = [p.split(":") for p in rest.split()]
    if kind in STEPS:
        return Model(kind, [(int(f), float(t), float(w)) for f, t, w in parts])
    if kind in LINEAR:
        return Model(kind, [(int(f), float(w)) for f, w in parts])
    raise ValueError(f"models of kind {kind} are kept as arrays, not as text")


def load(spark: SparkSession, path: str) -> Model:
    """A model file below any file system that Spark reads."""
    return parse(spark.read.text(path, wholetext=True).first().value)


def save(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(model.text(),)], "value string").coalesce(1).write.text(path)


def combined(models: list[Model]) -> Model:
    """One forest of several; the score is the mean of all their bags."""
    if any(m.kind != "Random Forests" for m in models):
        raise ValueError("only forests can be combined")
    return Model("Random Forests", [e for m in models for e in m.body])


def _linear_regression(df: DataFrame, **how) -> Model:
    w = ltr.linear_regression(df, **how)
    return Model("Linear Regression", [(0, w[-1]), *((k, v) for k, v in enumerate(w[:-1], 1))])


TRAINERS: dict[str, Callable[..., Model]] = {
    "MART": lambda df, **how: Model("MART", [trees.mart(df, **how)]),
    "RankBoost": lambda df, **how: Model("RankBoost", boosting.rank_boost(df, **how)),
    "AdaRank": lambda df, **how: Model("AdaRank", boosting.ada_rank(df, **how)),
    "Coordinate Ascent": lambda df, **how: Model("Coordinate Ascent", list(enumerate(ltr.coordinate_ascent(df, **how)[0], 1))),
    "LambdaMART": lambda df, **how: Model("LambdaMART", [trees.lambda_mart(df, **how)]),
    "Random Forests": lambda df, **how: Model("Random Forests", trees.random_forest(df, **how)),
    "Linear Regression": _linear_regression,
}


def train(kind: str | int, df: DataFrame, **how) -> Model:
    """Train by a kind's name or number on rows (query_id, doc_id, grade, feats)."""
    name = KINDS[kind] if isinstance(kind, int) else kind
    if name not in TRAINERS:
        raise ValueError(f"no trainer for {name}; known: {', '.join(TRAINERS)}")
    return TRAINERS[name](df, **how)


def ranked(df: DataFrame, model: Model, k: int = 1000) -> DataFrame:
    """query_id, doc_id, score, rank by a model."""
    return ltr.reranked(df, model.score(), k)


def evaluated(df: DataFrame, model: Model, k: int = 10) -> float:
    return ltr.mean_ndcg(df, [model.score()], k)[0]


def cross_validated(df: DataFrame, kind: str | int, n: int, k: int = 10, normalize: str | None = None, **how) -> list[float]:
    """The metric of each fold under a model trained on the others."""
    df = df if normalize is None else ltr.normalized(df, normalize)
    return [evaluated(test, train(kind, rest, **how), k) for rest, test in ltr.cross_validation(df, n)]
