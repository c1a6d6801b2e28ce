"""Large binary and array files by byte ranges: many tasks a file, whatever its format's marks.

A Python data source plans ranges of ``RANGE_BYTES``; a record belongs to the range in which it begins.

``bson`` has no marks between its length-prefixed entries. A range looks for the first place from which
``CHAIN`` whole entries with an id (or all up to the file's end) follow each other byte by byte, and
reads on until an entry begins beyond its end. There it looks for its neighbour's first place
in the same way: if that isn't where its own entries have led it, the file is an error (an
entry holds what looks like a run of entries), and must be read in one range.

``json_objects`` reads the objects of files that are one array each. Whether a byte lies within a string
and how deep depends on all that stands before it. So each range first counts, for either case, how it
would change that; the counts of the ranges before, added up, give each range its state, and a second
pass cuts out the objects that begin in it. What reaches the driver is three numbers a range.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ranklode.session import qualified, ship

RANGE_BYTES, CHAIN, WINDOW = 32 << 20, 3, 1 << 20
DOCNO = "DOCNO"


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    where, name = _place(path)
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def planned(path: str, size: int = 0) -> list[tuple[str, int, int, int]]:
    """(file, its bytes, first byte, end) of each range."""
    size = size or RANGE_BYTES
    return [(f, n, a, min(a + size, n)) for f, n in _files(path) for a in range(0, n, size)]


class Bytes:
    """Bytes of a file by places, read in windows."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.first, self.data = stream, size, 0, b""

    def __call__(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if a < self.first or b > self.first + len(self.data):
            self.stream.seek(a)
            self.first, self.data = a, self.stream.read(max(b - a, min(WINDOW, self.size - a)))
        return self.data[a - self.first : b - self.first]


def entry(data: Bytes, at: int) -> tuple[dict | None, int]:
    """The fields of the entry at a place and its end; None where there is no whole entry of strings
    and binaries."""
    head = data(at, at + 4)
    size = struct.unpack("<i", head)[0] if len(head) == 4 else 0
    if size < 5 or at + size > data.size:
        return None, at
    if data(at + size - 1, at + size) != b"\0":
        return None, at
    raw, out, p, end = data(at, at + size), {}, 4, size - 1
    while p < end:
        kind, stop = raw[p], raw.find(b"\0", p + 1, end)
        if stop < 0 or kind not in (2, 5) or stop + 5 > end:
            return None, at
        name, p = raw[p + 1 : stop], stop + 1
        n = struct.unpack_from("<i", raw, p)[0]
        a, b = (p + 4, p + 3 + n) if kind == 2 else (p + 5, p + 5 + n)
        p = b + (kind == 2)
        if n < (kind == 2) or p > end or (kind == 2 and raw[b] != 0):
            return None, at
        try:
            out[name.decode()] = raw[a:b].decode() if kind == 2 else raw[a:b]
        except UnicodeDecodeError:
            return None, at
    return out, at + size


def first_entry(data: Bytes, at: int) -> int:
    """The first place from ``at`` on where whole entries follow each other; the file's end if there is none."""
    while at < data.size:
        some = data(at, at + WINDOW + 4)
        # Bytes that can begin an entry: a length that fits, and a field of a known kind.
        raw = np.frombuffer(some, np.uint8).astype(np.int64)
        n = max(len(raw) - 4, 0)
        size = raw[:n] + (raw[1 : n + 1] << 8) + (raw[2 : n + 2] << 16) + (raw[3 : n + 3] << 24)
        fits = (size >= 5) & (size <= data.size - at - np.arange(n)) & np.isin(raw[4 : n + 4], (2, 5))
        for o in np.flatnonzero(fits).tolist():
            p = at + o
            for _ in range(CHAIN):
                if p == data.size:
                    break
                found, p = entry(data, p)
                if found is None or DOCNO not in found:
                    break
            else:
                return at + o
            if p == data.size and found and DOCNO in found:
                return at + o
        at += max(n, 1)
    return data.size


class _Range(InputPartition):
    def __init__(self, file: str, size: int, start: int, end: int):
        self.file, self.size, self.start, self.end = file, size, start, end


class _BsonReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", 0) or options.get("rangeBytes", 0))

    def partitions(self):
        return [_Range(*x) for x in planned(self.path, self.bytes)]

    def read(self, part: _Range):
        where, _ = _place(self.path)
        rows = []
        with where.open_input_file(part.file) as stream:
            data = Bytes(stream, part.size)
            at = first_entry(data, part.start) if part.start else 0
            while at < part.end:
                found, after = entry(data, at)
                if found is None or DOCNO not in found:
                    raise ValueError(f"{part.file}, byte {at}: no entry of strings and binaries with {DOCNO}")
                rows += [(found[DOCNO], k, v.encode() if isinstance(v, str) else v) for k, v in found.items() if k != DOCNO]
                at = after
                if len(rows) >= 512:
                    yield self.batch(rows)
                    rows = []
            if part.end < part.size and first_entry(data, part.end) != at:
                raise ValueError(f"{part.file}, byte {part.end}: entries can't be told apart here, read the file in one range")
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows):
        docno, field, value = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(docno, pa.string()), pa.array(field, pa.string()), pa.array(value, pa.binary())], names=[DOCNO, "field", "value"])


class BsonSource(DataSource):
    """spark.read.format("bson_entries").load(path): DOCNO, field, value of length-prefixed entries;
    option rangeBytes."""

    @classmethod
    def name(cls):
        return "bson_entries"

    def schema(self):
        return f"{DOCNO} string, field string, value binary"

    def reader(self, schema):
        return _BsonReader(self.options)


def bson(spark: SparkSession, path: str, range_bytes: int = 0) -> DataFrame:
    ship(spark)
    spark.dataSource.register(BsonSource)
    return spark.read.format("bson_entries").option("rangeBytes", str(range_bytes or RANGE_BYTES)).load(qualified(spark, path))


# --- arrays of JSON objects -------------------------------------------------------------


def _marks(raw: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes that no backslash escapes, and of brackets; ``odd``: an odd number of
    backslashes stands before the first byte."""
    slash = raw == 0x5C
    at = np.flatnonzero(raw == 0x22)
    # Backslashes right before each quote: from the last other byte on.
    other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw)))) if len(raw) else np.zeros(0, np.int64)
    before = np.where(at > 0, other[np.maximum(at - 1, 0)], -1)
    run = at - 1 - before
    run += (before < 0) * int(odd)
    quotes = at[run % 2 == 0]
    return quotes, np.flatnonzero(np.isin(raw, (0x7B, 0x7D, 0x5B, 0x5D)))


def _odd_before(stream, at: int) -> bool:
    n = 0
    while at > n:
        stream.seek(at - n - 1)
        if stream.read(1) != b"\\":
            break
        n += 1
    return n % 2 == 1


def changes(raw: np.ndarray, odd: bool) -> tuple[bool, int, int]:
    """Whether a range ends a string that is open or opens one that isn't, and by how much the depth
    changes, if it begins outside a string and if within one."""
    quotes, brackets = _marks(raw, odd)
    inside = np.searchsorted(quotes, brackets) % 2 == 1
    step = np.where((raw[brackets] == 0x7B) | (raw[brackets] == 0x5B), 1, -1)
    return len(quotes) % 2 == 1, int(step[~inside].sum()), int(step[inside].sum())


def objects(stream, size: int, start: int, end: int, within: bool, depth: int):
    """The texts of the objects right below the file's array that begin in a range."""
    stream.seek(start)
    raw = np.frombuffer(stream.read(end - start), np.uint8)
    begun = None  # bytes of an object that has begun
    odd = _odd_before(stream, start)
    at = start
    while True:
        quotes, brackets = _marks(raw, odd)
        outside = brackets[(np.searchsorted(quotes, brackets) % 2 == 1) == within]
        step = np.where((raw[outside] == 0x7B) | (raw[outside] == 0x5B), 1, -1)
        after = depth + np.cumsum(step)
        first = 0
        for p, level, s in zip(outside.tolist(), after.tolist(), step.tolist(), strict=True):
            if s > 0 and level == 2 and raw[p] == 0x7B and at < end:
                begun, first = [], p
            elif s < 0 and level == 1 and begun is not None:
                yield b"".join([*begun, raw[first : p + 1].tobytes()])
                begun = None
                if at >= end:
                    return
        if begun is not None:
            begun.append(raw[first:].tobytes())
        depth, within = int(after[-1]) if len(after) else depth, within ^ (len(quotes) % 2 == 1)
        at += len(raw)
        if begun is None or at >= size:
            return
        odd = _odd_before(stream, at)
        stream.seek(at)
        raw = np.frombuffer(stream.read(min(WINDOW, size - at)), np.uint8)


def json_objects(spark: SparkSession, path: str, schema: str | None = None, range_bytes: int = 0) -> DataFrame:
    """The objects of files that are one JSON array each, parsed by a schema, or as texts (value)."""
    ship(spark)
    path = qualified(spark, path)
    ranges = planned(path, range_bytes)
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(ranges)], "k long, file string, size long, start long, stop long").repartition(max(1, len(ranges)), "k")

    def count(batches):
        where, _ = _place(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                with where.open_input_file(r["file"]) as stream:
                    odd = _odd_before(stream, r["start"])
                    stream.seek(r["start"])
                    raw = np.frombuffer(stream.read(r["stop"] - r["start"]), np.uint8)
                    if r["start"] == 0 and raw.tobytes().lstrip()[:1] != b"[":
                        raise ValueError(f"{r['file']} is no JSON array")
                    out.append((r["k"], *changes(raw, odd)))
            yield pa.RecordBatch.from_pylist([dict(zip(("k", "flips", "out", "within"), x, strict=True)) for x in out], schema=pa.schema([("k", pa.int64()), ("flips", pa.bool_()), ("out", pa.int64()), ("within", pa.int64())]))

    states, inside, depth = [], False, 0
    for r in sorted(rows.mapInArrow(count, "k long, flips boolean, out long, within long").collect()):
        if ranges[r.k][2] == 0:
            inside, depth = False, 0
        states.append((r.k, inside, depth))
        depth += r.within if inside else r.out
        inside ^= r.flips

    def cut(batches):
        where, _ = _place(path)
        for b in batches:
            for r in b.to_pylist():
                with where.open_input_file(r["file"]) as stream:
                    some = []
                    for x in objects(stream, r["size"], r["start"], r["stop"], r["inside"], r["depth"]):
                        some.append(x.decode())
                        if len(some) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(some)], names=["value"])
                            some = []
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(some)], names=["value"])

    state = spark.createDataFrame(states, "k long, inside boolean, depth long")
    out = rows.join(F.broadcast(state), "k").mapInArrow(cut, "value string")
    return out.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("v.*") if schema else out
