"""Documents in chunks, and exchanges between chunks and hash buckets.

A chunk is all documents whose id hashes to one number: a few MB of text. A chunk tells
each bucket once which hashes it has, however often it has them, and a bucket answers
each chunk once. So a key that a third of all documents share costs one entry for each
chunk, and neither side ever gathers an unbounded group. Both numbers follow the bytes of text, and
an exchange has at most as many rows as hashes, however many chunks and buckets; the tasks that
take them in turn are those of the cluster's setting, or up to ``MOST_PARTS`` more. Rows without
doc_id are dealt by text and place in the input, so they fill no chunk. The text is shuffled once: every
step over the chunks reads the same exchange, which Spark reuses within a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.session import n_shuffle

#: Text of a chunk, and the least that is worth a chunk of its own to keep all cores busy.
CHUNK_BYTES, LEAST_BYTES = 4 << 20, 1 << 20
PART_BYTES, MOST_PARTS = 24 << 20, 20_000


@dataclass
class Chunked:
    docs: DataFrame  # c, doc_id, text
    chunks: int
    buckets: int
    bytes: int


def chunked(docs: DataFrame) -> Chunked:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(n_shuffle(spark), min(-(-size // PART_BYTES), MOST_PARTS))
    chunks = max(-(-size // CHUNK_BYTES), min(4 * parts, -(-size // LEAST_BYTES)), 1)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.spark_partition_id())).otherwise(F.xxhash64("doc_id"))
    c = F.pmod(key, F.lit(chunks)).cast("int").alias("c")
    return Chunked(docs.select(c, "doc_id", "text").repartition(parts, "c"), chunks, min(chunks, 32 * parts), size)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns' rows of it), rows in their order."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield (int(bucket[rows[0]]), *(x[rows] for x in columns))


def rows(schema: pa.Schema, data: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in data], f.type) for k, f in enumerate(schema)], schema=schema)


def packed(names: str, *more: tuple[str, pa.DataType]) -> pa.Schema:
    """Int keys and binary payloads: "b c | h pos" is two keys and two payloads."""
    keys, _, loads = names.partition("|")
    return pa.schema([*((k, pa.int32()) for k in keys.split()), *((k, pa.binary()) for k in loads.split()), *more])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def shared_hashes(df: DataFrame, dtype, least: int = 2) -> DataFrame:
    """From rows (b, c, h: sorted distinct hashes): rows (c, h) of those hashes that at
    least ``least`` chunks have."""
    back = packed("c | h")

    def bucket(table: pa.Table) -> pa.Table:
        c = table.column("c").to_numpy()
        loads = [np.frombuffer(x, dtype) for x in table.column("h").to_pylist()]
        h = np.concatenate(loads) if loads else np.zeros(0, dtype)
        ordered = np.sort(h)
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(h) else np.zeros(0, np.int64)
        often = ordered[starts][np.diff(np.r_[starts, len(h)]) >= least]
        out: dict[int, list[np.ndarray]] = {}
        for k, x in zip(c, loads, strict=True):
            at = np.searchsorted(often, x)
            at[at == len(often)] = 0
            hit = x[often[at] == x] if len(often) else x[:0]
            if len(hit):
                out.setdefault(int(k), []).append(hit)
        return rows(back, [(k, blob_of(v)) for k, v in out.items()])

    return df.groupBy("b").applyInArrow(bucket, ddl(back))


def shared_counts(df: DataFrame, dtype, least: int = 2) -> DataFrame:
    """As ``shared_hashes``: rows (c, b, h, n), with n about four times the logarithm of the
    number of chunks that have each hash, in a byte."""
    back = packed("c b | h n")

    def bucket(table: pa.Table) -> pa.Table:
        c, b = table.column("c").to_numpy(), table.column("b")[0].as_py()
        loads = [np.frombuffer(x, dtype) for x in table.column("h").to_pylist()]
        value, times = np.unique(np.concatenate(loads), return_counts=True)
        value, times = value[times >= least], times[times >= least]
        level = np.minimum(255, 4 * np.log2(times)).astype(np.uint8)
        if not len(value):
            return back.empty_table()
        out = []
        for k, x in zip(c, loads, strict=True):
            at = np.searchsorted(value, x)
            at[at == len(value)] = 0
            at = at[value[at] == x]
            if len(at):
                out.append((int(k), b, value[at].tobytes(), level[at].tobytes()))
        return rows(back, out)

    return df.groupBy("b").applyInArrow(bucket, ddl(back))


def blob_of(parts: list[np.ndarray]) -> bytes:
    return b"".join(x.tobytes() for x in parts)
