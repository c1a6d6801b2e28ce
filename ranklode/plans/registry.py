"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranklode.session import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)  # texts and pages come to Python in few rows a batch
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.dir, name)


def query(sql: str | None = None, ctes: str = "", name: str | None = None):
    """Register a function of Tables; ``ctes`` are common table expressions before ``sql``."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[key] = f"WITH {ctes.strip().rstrip(',')}\n{sql}" if ctes else sql
        return f

    return add
