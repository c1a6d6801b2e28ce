"""Places and running sums in a global order, without a task that sees all rows.

Rows are dealt by ranges of the order, sorted within each and written with their place there.
The driver adds up one number for each range; every row then gets its range's start.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklode.session import cut


def _ranged(df: DataFrame, order: tuple) -> DataFrame:
    """Written rows with _range and _at, their place in it from 0."""
    at = F.monotonically_increasing_id()  # the number of the range, and 33 bits for the place
    x = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    return x.withColumn("_range", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))


def _starts(x: DataFrame, what: Column) -> list[tuple]:
    """(range, what comes before it, its own) in order."""
    per = sorted(x.groupBy("_range").agg(what.alias("n")).collect())
    return [(r, before, n) for (r, n), before in zip(per, accumulate((n for _, n in per), initial=type(per[0][1])(0) if per else 0), strict=False)]


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """Each row's place from 1 as column ``name``; the order must tell all rows apart."""
    x = _ranged(df, order)
    starts = df.sparkSession.createDataFrame([s[:2] for s in _starts(x, F.count("*"))], "_range int, _before long")
    return x.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def running(df: DataFrame, value: str, *order: str | Column, name: str = "upto") -> tuple[DataFrame, list[tuple]]:
    """Rows with _range and the sum of ``value`` up to and with each row as column ``name``, and
    (range, sum before it, its own sum) of the ranges."""
    x = _ranged(df, order)
    starts = _starts(x, F.sum(value))
    before = df.sparkSession.createDataFrame([s[:2] for s in starts], f"_range int, _before {x.agg(F.sum(value).alias('s')).schema['s'].dataType.simpleString()}")
    w = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_sum", F.sum(value).over(w)).join(F.broadcast(before), "_range")
    return x.select("_range", *df.columns, (F.col("_before") + F.col("_sum")).alias(name)), starts
