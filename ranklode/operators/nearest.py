"""Nearest vectors by blocked matrix products: exact, and by an inverted file over cells.

Rows (id, v) are packed into blocks and written below one folder for each group. A task takes a block
of queries and a group, reads the group's blocks one by one and keeps the best k of each query so
far; it sends on k rows a query, and Spark ranks those of all groups. No pair of rows ever stands in
a table of its own, and nothing is broadcast.

``knn`` deals rows into groups as they are read, and each query meets all: exact. ``Cells`` is an
inverted file: k-means cells, fitted on a sample of at most ``SAMPLE`` rows a cell (the least hashes
of their ids), take every row; a query looks into its ``probes`` nearest cells. A cell with more than
``GROUP_ROWS`` rows (copies of one vector) is split into several groups.

Ranks are by score rounded to six decimals, then id, both descending. Metrics: ``dot``,
``cosine`` (norms below 1e-10 count as that) and ``l2`` (the negative distance). Null vectors and
those with null or non-finite components take no part, as query or as row; shorter vectors are continued
by zeros. Rows that share an id are rows by themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklode.operators.candidates import top
from ranklode.session import cut, shared_dir, ship
from ranklode.sources import shared

ROWS, QUERIES, GROUP_ROWS, MOST_TASKS = 4096, 512, 1 << 20, 20_000
CELLS, SAMPLE, ITERATIONS = 64, 256, 8


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and those as a matrix."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    x = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    keep = size >= 0
    keep[row[~np.isfinite(x)]] = False
    place = np.arange(len(x)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    out = np.zeros((len(size), dims))
    out[row, place] = x
    return keep, out[keep]


def _packed(rows: DataFrame, dims: int, size: int, key: str | None = None) -> DataFrame:
    """Blocks (g, ids, x) of rows (id, v[, key]), in the order in which tasks find them; with a
    key, of one key each."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["g", "ids", "x"]

    def run(batches):
        number, ids, parts = None, [], []

        def block():
            x = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([number or 0], pa.int32()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([x.tobytes()], pa.binary())], names=names)

        for b in batches:
            keep, x = _matrix(b.column("v"), dims)
            left = b.filter(pa.array(keep))
            groups = left.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(len(x), np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(x)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                while i < j:
                    have = sum(map(len, parts))
                    if parts and (have >= size or groups[i] != number):
                        yield block()
                        ids, parts, have = [], [], 0
                    number, end = int(groups[i]), min(j, i + size - have)
                    ids.append(left.column("id").slice(i, end - i))
                    parts.append(x[i:end])
                    i = end
        if parts:
            yield block()

    return rows.mapInArrow(run, f"g int, ids array<{kind}>, x binary")


class _Best:
    """The best k of each of n queries so far."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, query, score, id_) -> None:
        if self.id is not None:
            query, score, id_ = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, id_)))
        if not len(query):
            return
        by_id = np.empty(len(id_), np.int64)
        by_id[np.argsort(id_, kind="stable")] = np.arange(len(id_))
        order = np.lexsort((-by_id, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < self.k]
        self.query, self.score, self.id = query[order], score[order], id_[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.floor)) == self.k)
        self.floor[full] = self.score[np.searchsorted(self.query, full, side="right") - 1]


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "cosine":
        s /= np.maximum(np.linalg.norm(q, axis=1), 1e-10)[:, None] * np.maximum(np.linalg.norm(x, axis=1), 1e-10)
    elif metric == "l2":
        s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * s, 0))
    elif metric != "dot":
        raise ValueError(f"no metric {metric}")
    return np.round(s, 6) + 0.0


def _found(blocks: DataFrame, path: str, dims: int, k: int, metric: str, drop_self: bool) -> DataFrame:
    """Blocks (g, ids, x) of queries against the group g below a path: query_id, doc_id, score."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("ids")[r].values
                name = ids.to_numpy(zero_copy_only=False)
                q = np.frombuffer(b.column("x")[r].as_py()).reshape(len(ids), dims)
                best = _Best(len(q), k)
                for data in shared.batches(f"{path}/g={b.column('g')[r].as_py()}", ["ids", "x"]):
                    doc = data.column("ids")[0].values.to_numpy(zero_copy_only=False)
                    s = _scores(q, np.frombuffer(data.column("x")[0].as_py()).reshape(len(doc), dims), metric)
                    if drop_self:
                        s[name[:, None] == doc] = -np.inf
                    if s.shape[1] > k:  # nothing below the k-th of this block can be among the best
                        low = np.maximum(best.floor, np.partition(s, -k, axis=1)[:, -k])
                    else:
                        low = best.floor
                    i, j = np.nonzero((s >= low[:, None]) & (s > -np.inf))
                    for at in range(0, len(i), 1 << 20):  # rows of equal scores may be many
                        best.add(i[at : at + (1 << 20)], s[i, j][at : at + (1 << 20)], doc[j[at : at + (1 << 20)]])
                if best.id is not None:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), pa.array(best.id.tolist(), ids.type), pa.array(best.score)], names=["query_id", "doc_id", "score"])

    return blocks.mapInArrow(run, f"query_id {kind}, doc_id {kind}, score double")


def _written(blocks: DataFrame, what: str) -> str:
    path = shared_dir(blocks.sparkSession, what)
    blocks.write.partitionBy("g").option("parquet.block.size", str(16 << 20)).parquet(path)
    return path


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("id", "v").filter("v is not null")


def _query_blocks(queries: DataFrame, dims: int, n: int) -> DataFrame:
    return _packed(queries.repartition(max(1, -(-n // QUERIES))), dims, QUERIES)


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot", drop_self: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank of the k best rows of each query, by comparing all."""
    ship(docs.sparkSession)
    docs, queries = _vectors(docs), _vectors(queries)
    n, dims = docs.agg(F.count("*"), F.max(F.size("v"))).first()
    asked, wide = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, groups = max(dims or 0, wide or 0), max(1, -(-n // GROUP_ROWS))
    path = _written(_packed(docs, dims, ROWS).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))), "vectors")
    q = cut(_query_blocks(queries, dims, asked), "queries")
    q = q.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(min(4 * groups * max(1, -(-asked // QUERIES)), MOST_TASKS), "g", F.xxhash64("x"))
    return top(_found(q, path, dims, k, metric, drop_self), k)


class Cells:
    """An inverted file over all rows (id, v)."""

    def __init__(self, docs: DataFrame, cells: int = CELLS):
        spark = docs.sparkSession
        ship(spark)
        docs = _vectors(docs)
        self.dims = docs.agg(F.max(F.size("v"))).first()[0] or 0
        dims = self.dims
        sample = docs.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE).toArrow()
        keep, x = _matrix(sample.column("v").combine_chunks(), dims)
        self.centres = centres = fitted(x, cells)
        cell = self._nearest(docs, 1)
        sizes = {r.cell: r.n for r in cell.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most ``cells`` rows
        self.groups = {c: max(1, -(-sizes.get(c, 0) // GROUP_ROWS)) for c in range(len(centres))}
        most = max(self.groups.values(), default=1)
        parts = spark.createDataFrame(list(self.groups.items()), "cell int, parts int")
        g = (F.col("cell") * most + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).cast("int")
        dealt = cell.join(F.broadcast(parts), "cell").select("id", "v", g.alias("g"))
        self.most, self.path = most, _written(_packed(dealt.repartition("g").sortWithinPartitions("g"), dims, ROWS, "g"), "cells")

    def _nearest(self, rows: DataFrame, n: int) -> DataFrame:
        """id, v, cell: a row for each of the n nearest cells."""
        dims, centres, ddl = self.dims, self.centres, rows.schema

        def run(batches):
            for b in batches:
                keep, x = _matrix(b.column("v"), dims)
                left = b.filter(pa.array(keep))
                away = (centres * centres).sum(1) - 2 * x @ centres.T
                near = np.argsort(away, axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([left.column("id").take(at), left.column("v").take(at), pa.array(near.reshape(-1), pa.int32())], names=["id", "v", "cell"])

        kinds = {f.name: f.dataType.simpleString() for f in ddl.fields}
        return rows.mapInArrow(run, f"id {kinds['id']}, v {kinds['v']}, cell int")

    def search(self, queries: DataFrame, k: int, probes: int, metric: str = "dot", drop_self: bool = False) -> DataFrame:
        """query_id, doc_id, score, rank from the nearest cells of each query."""
        spark, most = queries.sparkSession, self.most
        each = spark.createDataFrame([(c, c * most + p) for c, n in self.groups.items() for p in range(n)], "cell int, g int")
        asked = self._nearest(_vectors(queries), probes).join(F.broadcast(each), "cell").select("id", "v", "g")
        blocks = _packed(asked.repartition("g").sortWithinPartitions("g"), self.dims, QUERIES, "g")
        return top(_found(cut(blocks, "queries").repartition(max(1, min(4 * len(self.groups) * most, MOST_TASKS)), "g", F.xxhash64("x")), self.path, self.dims, k, metric, drop_self), k)


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a sample by k-means, from every (n / cells)-th row; empty cells keep their centre."""
    cells = min(cells, len(x))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy() if cells else np.zeros((0, x.shape[1]))
    for _ in range(ITERATIONS if cells else 0):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres
