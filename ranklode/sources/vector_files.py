"""One file of vectors of several components, behind a head with their number: written by many
tasks, in order of ids.

Rows are dealt by ranges of the id and sorted. Each task writes its rows to a part of its own, under a name
that no other attempt has, and says how many there are; then one task copies the parts that were
reported, in order and block by block, behind the head, and the result is moved to its place. So a
task that runs again leaves only an unused part, and readers see the whole file or none.

Little-endian: the number of rows and of components, then for each component whether it is sparse and its
dimensions (0 if sparse); for each row the length and the ASCII bytes of its id, then its components: the number
of 32-bit floats and these, or, sparse, the number of pairs of a 32-bit dimension and a float.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.session import qualified, ship
from ranklode.sources.formats import component_header
from ranklode.sources.ranges import _place

COPY_BYTES = 8 << 20
PAIR = np.dtype([("dim", "<i4"), ("val", "<f4")])


def _row(id_: str, values: list, components: list[tuple[bool, int]]) -> bytes:
    if id_ is None or not id_.isascii():
        raise ValueError(f"no id of ASCII letters: {id_}")
    out = [np.int32(len(id_)).tobytes(), id_.encode()]
    for x, (sparse, dims) in zip(values, components, strict=True):
        if x is None:
            raise ValueError(f"{id_} lacks a component")
        if sparse:
            pairs = np.array(sorted((p["dim"], p["val"]) for p in x), PAIR)
            out += [np.int32(len(pairs)).tobytes(), pairs.tobytes()]
        else:
            if len(x) != dims:
                raise ValueError(f"{id_} has {len(x)} dimensions, not {dims}")
            out += [np.int32(dims).tobytes(), np.array(x, "<f4").tobytes()]
    return b"".join(out)


def write(rows: DataFrame, path: str, components: list[tuple[str, bool, int]], partitions: int | None = None) -> int:
    """Write rows (id, a column for each component: an array of floats, or of structs (dim, val)) and
    return their number. components: column, whether it is sparse, dimensions."""
    ship(rows.sparkSession)
    path = qualified(rows.sparkSession, path)
    kinds = [(sparse, dims) for _, sparse, dims in components]
    names = [c for c, _, _ in components]
    x = rows.select(F.col("id").cast("string").alias("id"), *names)
    x = (x.repartitionByRange(partitions, "id") if partitions else x.repartitionByRange("id")).sortWithinPartitions("id")
    parts = f"{path}.parts-{uuid.uuid4().hex}"

    def put(batches):
        where, folder = _place(parts)
        stream, n, name = None, 0, f"{uuid.uuid4().hex}"
        for b in batches:
            if b.num_rows and stream is None:
                where.create_dir(folder, recursive=True)
                stream = where.open_output_stream(f"{folder}/{name}")
            for r in b.to_pylist():
                stream.write(_row(r["id"], [r[c] for c in names], kinds))
            n += b.num_rows
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([n])], names=["k", "name", "n"])

    done = sorted(tuple(r) for r in x.mapInArrow(put, "k long, name string, n long").collect())  # a row a task
    total = sum(n for _, _, n in done)
    if total >= 1 << 31:
        raise ValueError("more rows than the head can say")
    head, order = np.int32(total).tobytes() + component_header(kinds), [name for _, name, _ in done]
    attempt = f"{path}.{uuid.uuid4().hex}"

    def join(batches):
        where, target = _place(attempt)
        _, folder = _place(parts)
        for b in batches:
            if b.num_rows:
                with where.open_output_stream(target) as out:
                    out.write(head)
                    for name in order:
                        with where.open_input_stream(f"{folder}/{name}") as part:
                            while block := part.read(COPY_BYTES):
                                out.write(block)
            yield b

    rows.sparkSession.range(1).coalesce(1).mapInArrow(join, "id long").collect()
    where, target = _place(path)
    where.move(_place(attempt)[1], target)
    if order:
        where.delete_dir(_place(parts)[1])
    return total


def read(path: str) -> tuple[list[tuple[bool, int]], list[tuple]]:
    """Components (whether sparse, dimensions) and rows (id, values of each) of a small file."""
    where, name = _place(path)
    with where.open_input_file(name) as stream:
        data = stream.read()
    n, width = np.frombuffer(data, "<i4", 2).tolist()
    kinds = [(bool(s), d) for s, d in np.frombuffer(data, "<i4", 2 * width, 8).reshape(-1, 2).tolist()]
    at, out = 8 + 8 * width, []
    for _ in range(n):
        size = int(np.frombuffer(data, "<i4", 1, at)[0])
        row, at = [data[at + 4 : at + 4 + size].decode()], at + 4 + size
        for sparse, dims in kinds:
            if sparse:
                m = int(np.frombuffer(data, "<i4", 1, at)[0])
                row.append([tuple(p) for p in np.frombuffer(data, PAIR, m, at + 4).tolist()])
                at += 4 + 8 * m
            else:
                row.append(np.frombuffer(data, "<f4", dims, at + 4).tolist())
                at += 4 + 4 * dims
        out.append(tuple(row))
    if at != len(data):
        raise ValueError("bytes behind the last row")
    return kinds, out
