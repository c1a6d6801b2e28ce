"""File discovery, and the smaller formats: codecs, packers, tables, reports."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklode.sources import files

# Suffixes of compressed files and of entry formats.
COMPRESSED = ("", ".gz", ".bz2")
TEXT_SUFFIX, BINARY_SUFFIX = ".jsonl", ".bin"
# End of fixed values.


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(name, is a folder) below a folder of any file system."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(path)] if fs.exists(path) else []


def variant(spark: SparkSession, path: str) -> str:
    """The one of path, path.gz and path.bz2 that is there; none or several are an error."""
    folder, _, name = path.rpartition("/")
    there = {n for n, _ in _listed(spark, folder or ".")}
    found = [f"{path}{s}" for s in COMPRESSED if f"{name}{s}" in there]
    if len(found) != 1:
        raise FileNotFoundError(f"{'no' if not found else 'more than one'} variant of {path}" + (f": {', '.join(found)}" if found else ""))
    return found[0]


def entry_format(name: str) -> str:
    """'text' or 'binary' by the suffix below a compression suffix."""
    for s in COMPRESSED[1:]:
        name = name.removesuffix(s)
    if name.endswith(TEXT_SUFFIX):
        return "text"
    if name.endswith(BINARY_SUFFIX):
        return "binary"
    raise ValueError(f"unknown entry format: {name}")


def entries(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Entries of whatever format the path says. Binary fields come as (id, field, value)."""
    return files.entries(spark, path, schema) if entry_format(path) == "text" else files.bson_entries(spark, path)


def data_folders(spark: SparkSession, top: str, data: str, queries: str) -> tuple[list[str], list[str], str]:
    """Sub-folders that hold a data file and those that hold a query file, and the suffix by which
    all of them are compressed; different suffixes are an error."""
    with_data, with_queries, suffixes = [], [], set()
    for name, folder in sorted(_listed(spark, top)):
        if not folder:
            continue
        there = {n for n, _ in _listed(spark, f"{top}/{name}")}
        for file, found in ((data, with_data), (queries, with_queries)):
            got = [s for s in COMPRESSED if f"{file}{s}" in there]
            if got:
                found.append(name)
                suffixes.update(got)
    if len(suffixes) > 1:
        raise ValueError(f"files are compressed in different ways: {sorted(suffixes)}")
    return with_data, with_queries, suffixes.pop() if suffixes else ""


def matching_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file, value: lines of the files of a folder whose names a regular expression matches."""
    names = [n for n, d in _listed(spark, folder) if not d and re.fullmatch(pattern, n)]
    if not names:
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text([f"{folder}/{n}" for n in sorted(names)]).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), "value")


def queries(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """Query entries (the id and the named fields), one row an id; a repeated id is an error."""
    x = files.entries(spark, path, ", ".join(f"`{f}` string" for f in (files.DOCNO, *fields)))
    n = F.count("*").alias("_n")
    one = x.groupBy(files.DOCNO).agg(n, *(F.first(f).alias(f) for f in fields))
    bad = F.raise_error(F.concat(F.lit("repeated id "), files.DOCNO)).cast("string")
    return one.select(F.when(F.col("_n") == 1, F.col(files.DOCNO)).otherwise(bad).alias(files.DOCNO), *fields)


def number_table(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """key, v: lines of a key and numbers between separators."""
    f = F.split("value", re.escape(sep))
    return files.lines(spark, path).select(f[0].alias("key"), F.transform(F.slice(f, F.lit(2), F.size(f)), lambda x: x.cast("double")).alias("v"))


# --- document entries -------------------------------------------------------------------
# A parsed document is its distinct word ids in ascending order, how often each comes, its words in
# order (or none) and its length.


def to_entry_text(ids="ids", counts="counts", positions="positions", length="length") -> Column:
    """'id:n id:n ...@ w w w ...@ length'; without positions the middle is empty."""
    pairs = F.array_join(F.zip_with(F.col(ids), F.col(counts), lambda i, n: F.concat_ws(":", i.cast("string"), n.cast("string"))), " ")
    words = F.coalesce(F.array_join(F.transform(F.col(positions), lambda x: x.cast("string")), " "), F.lit(""))
    return F.concat_ws("@", pairs, words, F.col(length).cast("string"))


def from_entry_text(c: str) -> Column:
    """A struct of ids, counts, positions (null if the entry has none) and length."""
    f = F.split(F.col(c), "@")
    pairs = F.transform(F.array_remove(F.split(f[0], " "), ""), lambda p: F.split(p, ":"))
    words = F.when(f[1] != "", F.transform(F.split(f[1], " "), lambda x: x.cast("int")))
    return F.struct(F.transform(pairs, lambda p: p[0].cast("int")).alias("ids"), F.transform(pairs, lambda p: p[1].cast("int")).alias("counts"), words.alias("positions"), f[2].cast("int").alias("length"))


@F.pandas_udf(T.BinaryType())
def entry_bytes(ids: pd.Series, counts: pd.Series, positions: pd.Series, length: pd.Series) -> pd.Series:
    """Little-endian 32-bit numbers: how many ids, how many positions (-1: none), the length, then
    ids, counts and positions."""

    def one(i, n, p, size):
        head = np.array([len(i), -1 if p is None else len(p), size], "<i4")
        return b"".join([head.tobytes(), *(np.asarray(x, "<i4").tobytes() for x in (i, n, [] if p is None else p))])

    return pd.Series([one(*x) for x in zip(ids, counts, positions, length, strict=True)])


@F.pandas_udf(T.StructType([*(T.StructField(k, T.ArrayType(T.IntegerType())) for k in ("ids", "counts", "positions")), T.StructField("length", T.IntegerType())]))
def entry_of_bytes(data: pd.Series) -> pd.DataFrame:
    def one(x):
        n, m, size = np.frombuffer(x, "<i4", 3).tolist()
        rest = np.frombuffer(x, "<i4", offset=12)
        return rest[:n], rest[n : 2 * n], None if m < 0 else rest[2 * n : 2 * n + m], size

    return pd.DataFrame([one(x) for x in data], columns=["ids", "counts", "positions", "length"])


# --- vectors ----------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def pack_sparse(ids: pd.Series, values: pd.Series) -> pd.Series:
    """int32 kind 1, int32 size, then (int32 id, float32 value) by id."""

    def one(i, v):
        if i is None or v is None:
            return None
        order = np.argsort(i, kind="stable")
        pairs = np.empty(len(i), np.dtype([("id", "<i4"), ("val", "<f4")]))
        pairs["id"], pairs["val"] = np.asarray(i)[order], np.asarray(v)[order]
        return np.array([1, len(i)], "<i4").tobytes() + pairs.tobytes()

    return pd.Series([one(*x) for x in zip(ids, values, strict=True)])


@F.pandas_udf(T.BinaryType())
def pack_entry(key: pd.Series, field: pd.Series, data: pd.Series) -> pd.Series:
    """A length-prefixed binary document of an id and one binary field."""

    def one(k, f, x):
        k, f, name = k.encode(), f.encode(), files.DOCNO.encode()
        body = b"\x02" + name + b"\0" + np.int32(len(k) + 1).tobytes() + k + b"\0" + b"\x05" + f + b"\0" + np.int32(len(x)).tobytes() + b"\0" + x + b"\0"
        return np.int32(len(body) + 4).tobytes() + body

    return pd.Series([one(*x) for x in zip(key, field, data, strict=True)])


def component_header(components: list[tuple[bool, int]]) -> bytes:
    """The head of a file of vectors of several components: their number, then (is sparse, dimensions)
    of each, as little-endian 32-bit numbers."""
    return np.array([len(components), *(x for sparse, dim in components for x in (int(sparse), 0 if sparse else dim))], "<i4").tobytes()


# --- training data and reports ----------------------------------------------------------


def write_pairs(pairs: DataFrame, path: str, keep_queries: DataFrame | None = None, keep_docs: DataFrame | None = None) -> None:
    """'query<TAB>doc[<TAB>score]' of distinct pairs, on demand only of the given ids (id)."""
    for side, keep in (("query_id", keep_queries), ("doc_id", keep_docs)):
        if keep is not None:
            pairs = pairs.join(keep.select(F.col("id").alias(side)).distinct(), side, "left_semi")
    names = [c for c in ("query_id", "doc_id", "score") if c in pairs.columns]
    pairs.select(*names).distinct().select(F.concat_ws("\t", *(F.col(c).cast("string") for c in names)).alias("value")).write.text(path)


def report_text(row: dict) -> str:
    """A report as lines of 'metric: value'."""
    return "\n".join(f"{k}: {v:.6f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.items()) + "\n"


def report_table(runs: dict[str, dict]) -> str:
    """A table of reports, tab-separated, a line a run."""
    names = list(dict.fromkeys(k for r in runs.values() for k in r))
    rows = [["run", *names], *([name, *(f"{r[k]:.6f}" if isinstance(r.get(k), float) else str(r.get(k, "")) for k in names)] for name, r in runs.items())]
    return "\n".join("\t".join(r) for r in rows) + "\n"


def report_value(text: str, metric: str) -> float:
    """The value of a metric in a report's text; exactly one line must have it."""
    found = re.findall(rf"(?m)^\s*{re.escape(metric)}\s*:\s*(\S+)\s*$", text)
    if len(found) != 1:
        raise ValueError(f"{len(found)} values of {metric}")
    return float(found[0])
