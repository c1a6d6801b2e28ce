"""Hard negatives of anchors by bit-sliced integer products.

Vectors become integers (``integers``) and are stored in blocks as bit-planes: for each binary
digit of the components one bit a component, 64 to a machine word. A product with an anchor is
taken plane by plane, most significant (the sign) first. What the planes below add lies between
the sums of the anchor's negative and of its positive components times the digits' largest
value, so each plane halves the interval in which a score can lie; a pair goes as soon as its
interval cannot reach what its anchor still looks for. While most pairs of a block live, a plane
is one matrix product; the few that are left go on by counting the bits that an anchor's planes
and a row's plane have in common.

Two passes, each over pairs of a block of anchors and a group of blocks of rows that a task reads
one by one from the shared folder, with the anchors' best so far as bounds: (1) the best
``positives`` rows of an anchor's label, (2) for each of them the best ``negatives`` rows of other
labels whose score lies within ``band`` per cent of the positive's. A task sends on at most so many
rows for each anchor; no other pair leaves it. Every anchor meets every row: the anchors are the
stated queries.

Higher scores come first, ties by smaller id, rows without id last. Rows without label or vector
take no part. An id that stands in several rows is several rows, but none of them is a positive of an
anchor of that id; a repeated anchor is mined as often as it stands there. An anchor without
another row of its label, or a positive without any row within the band (a negative score has none),
gives no row. Empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklode.llm import integers, store
from ranklode.llm import kernels as K
from ranklode.session import cut, shared_dir, ship, table

#: Rows of a block, anchors of a block, rows of a group of blocks, most tasks of a pass.
ROWS, ANCHORS, GROUP_ROWS, MOST_PARTS = 4096, 256, 1 << 20, 20_000
#: Pairs are followed one by one once this share of a block's is left.
FEW = 1 / 16
LEAST = -(1 << 60)
BLOCK = pa.schema([("b", pa.int64()), *((k, pa.binary()) for k in ("ids", "nulls", "labels", "planes"))])
BLOCK_DDL = "b long, ids binary, nulls binary, labels binary, planes binary"


def planes(x: np.ndarray) -> np.ndarray:
    """Bit-planes [digit, row, word] of two's complement integers, least digit first, sign last."""
    top = 1 + max((int(v).bit_length() for v in ((x.max(), ~x.min()) if x.size else ()) if v > 0), default=0)
    wide = -(-max(x.shape[1], 1) // 64) * 8
    out = np.zeros((top, len(x), wide), np.uint8)
    for p in range(top):
        bits = np.packbits((x >> p & 1).astype(np.uint8), axis=1, bitorder="little")
        out[p, :, : bits.shape[1]] = bits
    return out.view(np.uint64)


class Block:
    """Rows by label, with their planes."""

    def __init__(self, dims: int, ids, nulls, labels, bits):
        self.dims, self.ids, self.nulls, self.labels, self.bits = dims, ids, nulls, labels, bits

    @classmethod
    def of(cls, row: dict, dims: int) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        bits = np.frombuffer(row["planes"], np.uint64).reshape(-1, len(ids), -(-max(dims, 1) // 64))
        return cls(dims, ids, np.frombuffer(row["nulls"], bool), np.frombuffer(row["labels"], np.int64), bits)

    def part(self, i: int, j: int) -> Block:
        return Block(self.dims, self.ids[i:j], self.nulls[i:j], self.labels[i:j], self.bits[:, i:j])

    def weight(self, p: int) -> int:
        return -(1 << p) if p == len(self.bits) - 1 else 1 << p

    def digits(self, p: int, dtype) -> np.ndarray:
        flat = np.ascontiguousarray(self.bits[p]).view(np.uint8)
        return np.unpackbits(flat, axis=1, bitorder="little", count=self.dims).astype(dtype)

    def values(self) -> np.ndarray:
        return sum((self.digits(p, np.int64) * self.weight(p) for p in range(len(self.bits))), np.zeros((len(self.ids), self.dims), np.int64))

    def runs(self):
        """label, first row, end of each label's rows."""
        cuts = np.flatnonzero(np.diff(self.labels)) + 1
        return [(int(self.labels[i]), int(i), int(j)) for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(self.ids)], strict=True)] if len(self.ids) else []


def _blocks(dims: int, size: int, scale: int):
    """Batches of (id, label, v) to rows of BLOCK."""

    def row(b: int, ids, nulls, labels, x):
        order = np.argsort(labels, kind="stable")
        load = (ids[order], nulls[order], labels[order], planes(x[order]))
        return pa.RecordBatch.from_arrays([pa.array([b]), *(pa.array([K.blob(c)], pa.binary()) for c in load)], schema=BLOCK)

    def run(batches):
        task, number, have = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            keep, x = integers.matrix(batch.column("v"), dims, scale)
            ids, nulls = K.ids(batch.column("id"))
            have.append((ids[keep], nulls[keep], batch.column("label").to_numpy(zero_copy_only=False)[keep], x))
            while sum(len(h[0]) for h in have) >= size:
                whole = [np.concatenate(c) for c in zip(*have, strict=True)]
                yield row(task << 32 | number, *(c[:size] for c in whole))
                number, have = number + 1, [tuple(c[size:] for c in whole)]
        if have and sum(len(h[0]) for h in have):
            yield row(task << 32 | number, *(np.concatenate(c) for c in zip(*have, strict=True)))

    return run


def scan(a: Block, x: Block, low: np.ndarray, high: np.ndarray, barred: np.ndarray | None = None, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs, but the barred, that score from ``low`` to ``high`` of
    their anchor. With ``best``, pairs below so many others of their anchor may be left out."""
    v = a.values()
    up, down = np.maximum(v, 0).sum(1), np.minimum(v, 0).sum(1)
    exact = np.float32 if int((up - down).max(initial=0)) << len(x.bits) < 1 << 24 else np.float64
    v, low, high = v.astype(exact), low.astype(np.float64), high.astype(np.float64)
    s = np.zeros((len(a.ids), len(x.ids)), exact)
    if barred is not None:
        s[barred] = -np.inf
    p = len(x.bits)
    while p:
        p -= 1
        s += (v * x.weight(p)) @ x.digits(p, exact).T
        rest = (1 << p) - 1  # what the digits below come to at most
        if best and s.shape[1] > best:
            low = np.maximum(low, np.partition(s, -best, axis=1)[:, -best] + down * float(rest))
        alive = (s >= (low - up * float(rest))[:, None]) & (s <= (high - down * float(rest))[:, None])
        if np.count_nonzero(alive) <= FEW * s.size:
            break
    i, r = np.nonzero(alive) if s.size else (np.zeros(0, np.int64),) * 2
    score = s[i, r].astype(np.int64)
    while p and len(i):
        p -= 1
        common = sum((np.bitwise_count(a.bits[q][i] & x.bits[p][r]).sum(1, dtype=np.int64) * a.weight(q) for q in range(len(a.bits))), np.zeros(len(i), np.int64))
        score = score + common * x.weight(p)
        rest = (1 << p) - 1
        keep = (score + up[i] * rest >= low[i]) & (score + down[i] * rest <= high[i])
        i, r, score = i[keep], r[keep], score[keep]
    return i, r, score


class Best:
    """The best k of each of n groups so far: group, score, id and whether it has none."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        none = np.zeros(0, np.int64)
        self.group, self.score, self.id, self.null = none, none, none, none.astype(bool)
        self.floor = np.full(n, LEAST)

    def add(self, group, score, id_, null) -> None:
        if not len(group):
            return
        group, score, id_, null = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, id_), (self.null, null)))
        order = np.lexsort((id_, null, -score, group))
        first = np.searchsorted(group[order], group[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.group, self.score, self.id, self.null = group[order], score[order], id_[order], null[order]
        full = np.flatnonzero(np.bincount(self.group, minlength=self.n) == self.k)
        self.floor[full] = self.score[np.searchsorted(self.group, full, side="right") - 1]


def _same_id(a: Block, x: Block) -> np.ndarray | None:
    at = np.flatnonzero(np.isin(x.ids, a.ids) & ~x.nulls)
    if not len(at):
        return None
    barred = np.zeros((len(a.ids), len(x.ids)), bool)
    barred[:, at] = (a.ids[:, None] == x.ids[at]) & ~a.nulls[:, None]
    return barred


def positives(a: Block, blocks, k: int) -> Best:
    """The best k rows of each anchor's label."""
    best, open_ = Best(len(a.ids), k), np.full(len(a.ids), float(1 << 60))
    own = {label: (i, j) for label, i, j in a.runs()}
    for x in blocks:
        for label, c, d in x.runs():
            if label in own:
                i, j = own[label]
                part, rows = a.part(i, j), x.part(c, d)
                first = k if (best.floor[i:j] == LEAST).any() else 0
                who, row, score = scan(part, rows, best.floor[i:j], open_[i:j], _same_id(part, rows), first)
                best.add(who + i, score, rows.ids[row], rows.nulls[row])
    return best


def negatives(a: Block, blocks, least: np.ndarray, most: np.ndarray, k: int) -> Best:
    """The best k rows of other labels with a score from least[i, j] to most[i, j], for each
    anchor i and window j; a window with least > most has none."""
    wide = least.shape[1]
    best = Best(least.size, k)
    real = least <= most
    high = np.where(real, most, LEAST).max(1, initial=LEAST)
    for x in blocks:
        low = np.maximum(least, best.floor.reshape(least.shape))
        low = np.where(real & (low <= most), low, 1 << 60)
        who, row, score = scan(a, x, low.min(1, initial=1 << 60), high, a.labels[:, None] == x.labels)
        pair, j = np.nonzero((score[:, None] >= low[who]) & (score[:, None] <= most[who]))
        best.add(who[pair] * wide + j, score[pair], x.ids[row[pair]], x.nulls[row[pair]])
    return best


def _read(path: str, group: int, dims: int):
    where = f"{path}/g={group}"
    for f in store.place(where).files():
        if f.endswith(".parquet"):
            with store.open_file(where, f) as stream:
                for b in pq.ParquetFile(stream).iter_batches(batch_size=16):
                    for r in b.to_pylist():
                        yield Block.of(r, dims)


def _ranked(df: DataFrame, k: int, by: list[str], id_: str, score: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.col(id_).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mined(rows: DataFrame, n_positives: int = 5, n_negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = integers.SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows
    (id, label, v, anchor: whether the row is one)."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v", F.coalesce("anchor", F.lit(False)).alias("anchor")).filter("label is not null and v is not null")
    n, asked, dims = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    dims, groups, parts = dims or 0, max(1, -(-n // GROUP_ROWS)), max(1, -(-asked // ANCHORS))
    path = shared_dir(spark, "planes")
    plain = rows.select("id", "label", "v").mapInArrow(_blocks(dims, ROWS, scale), BLOCK_DDL)
    plain.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).write.partitionBy("g").option("parquet.block.size", str(16 << 20)).parquet(path)
    anchors = cut(rows.filter("anchor").select("id", "label", "v").repartition(parts).mapInArrow(_blocks(dims, ANCHORS, scale), BLOCK_DDL), "anchors")
    tasks = min(4 * parts * groups, MOST_PARTS)
    spread = lambda df: df.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "b", "g")

    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = Block.of(row, dims)
                got = positives(a, _read(path, row["g"], dims), n_positives)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got.group), row["b"])), pa.array(got.group, pa.int32()), K.id_array(got.id, got.null), pa.array(got.score)], names=["b", "i", "positive_id", "positive_score"])

    found = cut(_ranked(spread(anchors).mapInArrow(find, "b long, i int, positive_id long, positive_score long"), n_positives, ["b", "i"], "positive_id", "positive_score"), "positives")
    per = found.groupBy("b").agg(F.collect_list(F.struct("i", "rank", "positive_id", "positive_score")).alias("has"))
    lo, hi = band
    out = "b long, i int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def mine(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = Block.of(row, dims)
                score, known, none = (np.zeros((len(a.ids), n_positives), t) for t in (np.int64, np.int64, bool))
                least, most = np.ones((2, len(a.ids), n_positives), np.int64)
                most[:] = 0
                for h in row["has"]:
                    at, s = (h["i"], h["rank"] - 1), h["positive_score"]
                    score[at], known[at], none[at] = s, h["positive_id"] or 0, h["positive_id"] is None
                    least[at], most[at] = -(-lo * s // 100), hi * s // 100
                got = negatives(a, _read(path, row["g"], dims), least, most, n_negatives)
                i, j = got.group // n_positives, got.group % n_positives
                columns = [pa.array(np.full(len(i), row["b"])), pa.array(i, pa.int32()), pa.array(j, pa.int32()), K.id_array(a.ids[i], a.nulls[i]), K.id_array(known[i, j], none[i, j]), pa.array(score[i, j]), K.id_array(got.id, got.null), pa.array(got.score)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in out.split(", ")])

    pairs = spread(anchors.join(per, "b")).mapInArrow(mine, out)
    return _ranked(pairs, n_negatives, ["b", "i", "place"], "negative_id", "negative_score").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id 50 divides; where 7 divides it, the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"), (F.col("vec_id") % 50 == 0).alias("anchor")))


#: DuckDB SQL of ``of_embeddings``.
SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS alike, list_dot_product(a.q, e.q)::BIGINT AS score
      FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
