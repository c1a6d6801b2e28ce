"""Field pipelines: stages of components, each stage a projection of the one before.

A component is a function from settings to {output field: expression}. All components of a stage
see the fields of the stage before; what they give together is all that goes on. A field that two
components give is an error. The id comes back last, and the planner fuses the projections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklode.functions import parse as P
from ranklode.functions import text as T

COMPONENTS: dict[str, Callable[..., dict[str, Column]]] = {}


def component(name: str):
    def add(f):
        if name in COMPONENTS:
            raise ValueError(f"two components are called {name}")
        COMPONENTS[name] = f
        return f

    return add


@component("copy")
def copy(fields: list[str]) -> dict[str, Column]:
    return {f: F.col(f) for f in fields}


@component("rename")
def rename(mapping: dict[str, str]) -> dict[str, Column]:
    """Only mapped fields go on, under their new names."""
    return {new: F.col(old) for old, new in mapping.items()}


@component("concat")
def concat(fields: list[str], output: str) -> dict[str, Column]:
    """Fields joined by a blank; a missing one is empty."""
    return {output: F.concat_ws(" ", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))}


@component("stem")
def stem(fields: dict[str, str], stop: list[str] = ()) -> dict[str, Column]:
    return {new: P.stemmed(old, list(stop)) for old, new in fields.items()}


@component("lower")
def lower(fields: dict[str, str]) -> dict[str, Column]:
    return {new: F.array_join(T.tokens(old), " ") for old, new in fields.items()}


@component("html")
def html(body: str, content_type: str) -> dict[str, Column]:
    x = P.html_document(body, content_type)
    return {"body": x["body"], "title": x["title"]}


def run(df: DataFrame, id_: str, stages: list[list[tuple[str, dict]]]) -> DataFrame:
    """``stages``: lists of (component, settings). Returns the id and the last stage's fields."""
    for stage in stages:
        out: dict[str, Column] = {}
        for name, settings in stage:
            if name not in COMPONENTS:
                raise ValueError(f"no component {name}; known: {', '.join(sorted(COMPONENTS))}")
            given = COMPONENTS[name](**settings)
            twice = sorted(out.keys() & given.keys())
            if twice:
                raise ValueError(f"several components give {', '.join(twice)}")
            out |= given
        df = df.select(F.col(id_).alias("_id"), *(c.alias(k) for k, c in out.items())).withColumnRenamed("_id", id_) if id_ not in out else df.select(*(c.alias(k) for k, c in out.items()))
    return df
