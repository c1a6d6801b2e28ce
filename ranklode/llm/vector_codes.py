"""Vector codes: each part of an integer vector becomes the index of the nearest entry of its
part's codebook, found by annular norm pruning.

An entry's distance to a part is at least the difference of their norms. A codebook's entries are
sorted by norm; a part starts at its own norm's place there and looks at the next entry below and
above in turns, while the interval of norms that the best distance so far allows (found by binary
search, both ends inclusive and widened by what roundings of roots may amount to) shrinks. Only
entries inside that annulus are evaluated, by exact integer arithmetic; ties go to the lower index.

A codebook starts as the parts of the vectors with the smallest ids (fewer vectors: fewer
entries) and is refitted to the floors of its parts' means ``rounds`` times over all rows: a task
sums its own rows by entry, so what is shuffled and what the driver reads is bounded by the
codebooks. Entries that no part chose stay.

Rows without a vector, or with a null or non-finite component, are dropped. Vectors whose length is
no multiple of ``parts``, or that are shorter than others, are continued by zeros. Rows without id come
last among the smallest; equal ids are ordered by label and vector. Rows without label have one
error sum together. An empty table gives no codebook and no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklode.llm import integers
from ranklode.llm import kernels as K
from ranklode.session import cut, ship, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Labels whose sums may be broadcast (some 30 MB); beyond, Spark joins by shuffle.
BROADCAST_LABELS = 200_000


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norm = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.entries, self.norm = entries[self.order].astype(np.int64), norm[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, and how many were evaluated."""
        n, size = len(x), len(self.norm)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        at = np.searchsorted(self.norm, norm)
        best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, size)
        down, up = at - 1, at  # the next entries to look at
        first, end = np.zeros(n, np.int64), np.full(n, size)  # the annulus
        rows, seen = np.arange(n), 0
        while len(rows):
            for side in (down, up):
                todo = rows[(side[rows] >= first[rows]) & (side[rows] < end[rows])]
                entry = side[todo]
                distance = ((x[todo] - self.entries[entry]) ** 2).sum(1)
                name = self.order[entry]
                better = (distance < best[todo]) | (distance == best[todo]) & (name < index[todo])
                best[todo[better]], index[todo[better]] = distance[better], name[better]
                seen += len(todo)
            down[rows] -= 1
            up[rows] += 1
            reach = np.sqrt(best[rows].astype(np.float64))
            reach += 1e-9 * (1 + reach + norm[rows])
            first[rows] = np.searchsorted(self.norm, norm[rows] - reach, side="left")
            end[rows] = np.searchsorted(self.norm, norm[rows] + reach, side="right")
            rows = rows[(down[rows] >= first[rows]) | (up[rows] < end[rows])]
        return index, best, seen


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance [row, part] for integer rows and entries [part, entry, place]."""
    parts, _, wide = books.shape
    index, error = np.zeros((2, len(x), parts), np.int64)
    for k in range(parts):
        index[:, k], error[:, k], _ = Codebook(books[k]).nearest(x[:, k * wide : (k + 1) * wide].astype(np.int64))
    return index, error


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v").filter("v is not null")


def books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = integers.SCALE) -> np.ndarray:
    """Codebooks [part, entry, place within part] from rows (id, label, v)."""
    ship(rows.sparkSession)
    rows = _vectors(rows)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    wide = -(-dims // parts)

    def clean(batches):
        for b in batches:
            yield b.filter(pa.array(integers.matrix(b.column("v"), parts * wide, scale)[0]))

    first = rows.mapInArrow(clean, rows.schema).orderBy(F.col("id").asc_nulls_last(), F.col("label").asc_nulls_last(), "v").limit(entries)
    x = integers.matrix(first.toArrow().column("v"), parts * wide, scale)[1]
    found = np.ascontiguousarray(x.reshape(len(x), parts, wide).transpose(1, 0, 2)).astype(np.int64)
    for _ in range(rounds if len(x) else 0):
        now, shape = found, found.shape

        def add(batches, now=now, shape=shape):
            n, total = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
            for b in batches:
                x = integers.matrix(b.column("v"), parts * wide, scale)[1]
                index = assign(x, now)[0]
                for k in range(parts):
                    n[k] += np.bincount(index[:, k], minlength=shape[1])
                    np.add.at(total[k], index[:, k], x[:, k * wide : (k + 1) * wide])
            k, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array((k * shape[1] + e)), pa.array(n[k, e]), *(pa.array(total[k, e, j]) for j in range(wide))], names=["entry", "n", *(f"s{j}" for j in range(wide))])

        sums = [f"s{j}" for j in range(wide)]
        each = rows.mapInArrow(add, ", ".join(f"{c} long" for c in ("entry", "n", *sums)))
        got = each.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("n", *sums))).collect()
        found = now.copy()
        for r in got:
            found[divmod(r["entry"], shape[1])] = np.array([r[c] for c in sums], np.int64) // r["n"]
    return found


def encoded(rows: DataFrame, found: np.ndarray, scale: int = integers.SCALE) -> DataFrame:
    """id, label, code (an index a part), error of each row that has a vector."""
    parts, _, wide = found.shape

    def run(batches):
        for b in batches:
            keep, x = integers.matrix(b.column("v"), parts * wide, scale)
            index, error = assign(x, found)
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(index.reshape(-1), pa.int32()))
            kept = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), code, pa.array(error.sum(1))], names=["id", "label", "code", "error"])

    out = "id long, label long, code array<int>, error long"
    rows = _vectors(rows)
    return rows.mapInArrow(run, out) if found.size else rows.limit(0).selectExpr("id", "label", "cast(null as array<int>) code", "0L error")


def decoded(code: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The integer vectors that codes [row, part] stand for."""
    return found[np.arange(found.shape[0]), code].reshape(len(code), -1)


def digest(found: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, found.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the errors of equal labels together."""
    codes = cut(codes, "codes")
    per = cut(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "errors")
    if per.count() <= BROADCAST_LABELS:
        per = F.broadcast(per)
    return codes.join(per, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    found = books(rows)
    code = F.lower(F.array_join(F.transform("code", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return with_label_errors(encoded(rows, found)).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(found)).alias("codebooks_sha256"))


def _sql() -> str:
    nearest = "SELECT vec_id, p, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (SELECT x.vec_id, x.p, b.k, list_sum(list_transform(list_zip(x.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM x JOIN {} b USING (p)) GROUP BY vec_id, p"
    refit = (
        "SELECT p, k, list(coalesce(m, o) ORDER BY j) AS v FROM (SELECT b.p, b.k, j, b.v[j] AS o, floor(sum(x.v[j])::BIGINT / count(x.p))::BIGINT AS m "
        "FROM {0} b CROSS JOIN (SELECT unnest(range(1, 5)) AS j) LEFT JOIN {1} a ON a.p = b.p AND a.k = b.k LEFT JOIN x ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY b.p, b.k, j, b.v[j]) GROUP BY p, k"
    )
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, q[4 * p + 1 : 4 * p + 4] AS v FROM e CROSS JOIN (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM x QUALIFY k < 64),
a0 AS MATERIALIZED ({nearest.format("b0")}),
b1 AS MATERIALIZED ({refit.format("b0", "a0")}),
a1 AS MATERIALIZED ({nearest.format("b1")}),
b2 AS MATERIALIZED ({refit.format("b1", "a1")}),
a2 AS MATERIALIZED ({nearest.format("b2")}),
r AS (SELECT vec_id, string_agg(printf('%02x', k::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
FROM r JOIN e USING (vec_id)
"""


#: DuckDB SQL of ``of_embeddings``.
SQL = _sql()
