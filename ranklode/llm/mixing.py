"""Mixing sources to target weights, with repeats.

Sources share ``ratio`` times the words of all documents by weight; a target stops at
``most`` times its source's size and the excess goes to the others by weight until none is
above. A source's rate is target / size; each document is taken floor(rate) times, and once
more if its seeded hash, as a fraction, lies below the rate's fraction: reruns agree, and
adding documents changes no other document's draw.

A null text has size 0 and is emitted by its source's rate, which takes no words. The null
source is a source of its own, last in order. A null doc_id draws like the text "null"; rows
that share a doc_id share their draw. A source without words has target 0 and rate 0. An
empty table gives an empty result. ``emit`` carries each row as one value beside what it
computes, so columns of any name pass through unchanged. Texts are read once for the sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklode.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, RATIO, MOST, SEED = (3, 1, 2), (3, 2), 2, 17
#: Sources whose rates may be broadcast (some 30 MB); beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 200_000


def size() -> F.Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def rates(docs: DataFrame, weights=WEIGHTS, ratio=RATIO, most: int = MOST) -> DataFrame:
    """_src, source_size, target, _rate of each source, from rows (source, size).

    Filling in order of cap / weight: before source k, those with a smaller quotient are
    capped and the rest share what is left; the first k that isn't above its cap at that
    share sets the level for all.
    """
    up, down = ratio
    per = docs.select(F.col("source").alias("_src"), F.col("size").alias("_n")).groupBy("_src").agg(F.sum("_n").alias("source_size"))
    one = Window.orderBy(F.col("_src").asc_nulls_last())
    at = F.pmod(F.row_number().over(one) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("long")
    per = per.withColumn("_w", w).withColumn("_quotient", F.lit(most) * F.col("source_size") / F.col("_w"))
    by = Window.orderBy("_quotient", F.col("_src").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    share = (up * F.sum("source_size").over(everything) - down * most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (down * F.sum("_w").over(rest))
    per = per.withColumn("_share", share).withColumn("_k", F.row_number().over(by))
    level = F.min(F.when(F.col("_share") <= F.col("_quotient"), F.struct("_k", "_share"))).over(everything)["_share"]
    target = F.least((F.lit(most) * F.col("source_size")).cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))
    per = per.withColumn("target", target)
    return per.select("_src", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"))


def _copied(rows: DataFrame, per: DataFrame, seed: int) -> DataFrame:
    """Rows with doc_id and source, with the figures of their source and _copies."""
    per = cut(per, "rates")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = rows.join(per, F.col("source").eqNullSafe(F.col("_src")), "left")
    return out.withColumn("_copies", (F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("long")).cast("int"))


def shares(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each document."""
    sizes = cut(docs.select("doc_id", "source", size().alias("size")), "sizes")
    out = _copied(sizes, rates(sizes, **how), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"), F.col("_copies").cast("long").alias("copies"))


def emit(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source")
    out = _copied(rows, rates(docs.select("source", size().alias("size")), **how), seed).filter("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


#: DuckDB SQL of ``shares`` over documents ($DOCS: their relation).
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM $DOCS),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::BIGINT AS w FROM p),
q AS (SELECT *, (2 * source_size)::DOUBLE / w AS quotient FROM w),
r AS (SELECT *, row_number() OVER o AS k,
        (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (2 * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
      FROM q WINDOW o AS (ORDER BY quotient, source ASC NULLS LAST)),
l AS (SELECT arg_min(share, k) FILTER (WHERE share <= quotient) AS level FROM r),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(level, 0.0::DOUBLE) * w) AS target FROM r, l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target,
        (floor(rate) + ((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < rate - floor(rate))::INT)::BIGINT AS copies
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
