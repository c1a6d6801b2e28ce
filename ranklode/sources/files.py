"""Readers and writers of the text formats of retrieval experiments.

All read through Spark's own readers, so compressed files (gz, bz2) and any file system work,
and parsing is a projection that the planner can prune. Faulty input raises where the format
says it must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklode.functions.text import BLANK

DOCNO = "DOCNO"
FAKE_DOC = "FAKE_DOC"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def fields(spark: SparkSession, path, n: int | None = None) -> DataFrame:
    """Column f: the line's parts between blanks; with n, other lines are an error."""
    x = lines(spark, path).select(F.split(F.trim(F.regexp_replace("value", BLANK, " ")), " ").alias("f"), "value")
    if n is not None:
        x = x.withColumn("f", F.when(F.size("f") == n, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} columns: "), F.col("value"))).cast("array<string>")))
    return x.select("f")


def _part(k: int, kind: str = "string") -> Column:
    return F.col("f")[k].cast(kind)


# --- entries ----------------------------------------------------------------------------


def entries(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """JSON lines with an id: primitives as strings, arrays of strings; a bad line is an error."""
    x = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return x.withColumn(DOCNO, F.coalesce(DOCNO, F.raise_error(F.lit(f"an entry without {DOCNO}")).cast("string")))


def write_entries(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("compression", compression).option("ignoreNullFields", "true").json(path)


def parallel_queries(text: DataFrame, binary: DataFrame) -> DataFrame:
    """Entries of two files, joined one to one on the id."""
    one = text.withColumn("_n", F.count("*").over(Window.partitionBy(DOCNO))).join(binary.withColumn("_m", F.count("*").over(Window.partitionBy(DOCNO))), DOCNO, "full")
    bad = F.col("_n").isNull() | F.col("_m").isNull() | (F.col("_n") > 1) | (F.col("_m") > 1)
    return one.withColumn(DOCNO, F.when(bad, F.raise_error(F.concat(F.lit("no single match for "), DOCNO)).cast("string")).otherwise(F.col(DOCNO))).drop("_n", "_m")


def bson_entries(spark: SparkSession, path: str, range_bytes: int = 0) -> DataFrame:
    """Length-prefixed BSON files as (DOCNO, field, value): strings and binaries only; large files by
    ranges."""
    from ranklode.sources import ranges

    return ranges.bson(spark, path, range_bytes)


def dense_from_packed(c: str) -> Column:
    """Array of floats of a packed dense vector: int32 kind 0, then little-endian float32."""
    return _packed_dense(F.col(c))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _packed_dense(values):
    import numpy as np
    import pandas as pd

    def one(x):
        if x is None:
            return None
        if np.frombuffer(x, "<i4", 1)[0] != 0:
            raise ValueError("not a dense vector")
        return np.frombuffer(x, "<f4", offset=4)

    return pd.Series([one(x) for x in values])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("val", T.FloatType())])))
def _packed_sparse(values):
    import numpy as np
    import pandas as pd

    def one(x):
        if x is None:
            return None
        kind, n = np.frombuffer(x, "<i4", 2)
        if kind != 1:
            raise ValueError("not a sparse vector")
        pairs = np.frombuffer(x, np.dtype([("id", "<i4"), ("val", "<f4")]), n, 8)
        return [{"id": int(p["id"]), "val": float(p["val"])} for p in pairs]

    return pd.Series([one(x) for x in values])


def sparse_from_packed(c: str) -> Column:
    return _packed_sparse(F.col(c))


@F.pandas_udf(T.BinaryType())
def pack_dense(values):
    import numpy as np
    import pandas as pd

    return pd.Series([None if v is None else np.int32(0).tobytes() + np.asarray(v, "<f4").tobytes() for v in values])


# --- judgements and runs ----------------------------------------------------------------


def qrels(spark: SparkSession, path) -> DataFrame:
    return fields(spark, path, 4).select(_part(0).alias("query_id"), _part(2).alias("doc_id"), _part(3, "double").alias("grade"))


def unique_qrels(q: DataFrame) -> DataFrame:
    """One row a pair; differing grades are an error."""
    g = q.groupBy("query_id", "doc_id").agg(F.min("grade").alias("grade"), F.max("grade").alias("_hi"))
    return g.select("query_id", "doc_id", F.when(F.col("grade") == F.col("_hi"), F.col("grade")).otherwise(F.raise_error(F.concat(F.lit("several grades for "), "query_id", F.lit(" "), "doc_id")).cast("double")).alias("grade"))


def _text(df: DataFrame, line: Column, path: str, order: list | None = None) -> None:
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.select(line.alias("value")).write.text(path)


def write_qrels(q: DataFrame, path: str) -> None:
    _text(q, F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.format_string("%.0f", F.col("grade").cast("double"))), path, ["query_id", "doc_id"])


def run(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """query_id, doc_id, rank, score. ``strict``: ranks must run from 1 without gaps, and the
    placeholder of empty results is dropped; else the last of repeated pairs counts."""
    x = fields(spark, path, 6).select(_part(0).alias("query_id"), _part(2).alias("doc_id"), _part(3, "int").alias("rank"), _part(4, "double").alias("score"))
    if not strict:
        last = x.groupBy("query_id", "doc_id").agg(F.max_by(F.struct("rank", "score"), "rank").alias("_l"))
        return last.select("query_id", "doc_id", "_l.rank", "_l.score")
    w = Window.partitionBy("query_id").orderBy("rank")
    ok = F.col("rank") == F.row_number().over(w)
    x = x.withColumn("rank", F.when(ok, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("ranks of query "), "query_id", F.lit(" have a gap"))).cast("int")))
    return x.filter(F.col("doc_id") != FAKE_DOC)


def run_file_faults(spark: SparkSession, path) -> DataFrame:
    """line, fault: lines that haven't six columns, and run ids after the first of the file order."""
    x = lines(spark, path).select("value", F.split(F.trim(F.regexp_replace("value", BLANK, " ")), " ").alias("f"))
    ids = x.filter(F.size("f") == 6).select(_part(5).alias("id")).agg(F.min("id").alias("_id"))
    short = x.filter(F.size("f") != 6).select(F.col("value").alias("line"), F.lit("not six columns").alias("fault"))
    other = x.filter(F.size("f") == 6).crossJoin(F.broadcast(ids)).filter(_part(5) != F.col("_id"))  # one row
    return short.unionByName(other.select(F.col("value").alias("line"), F.lit("another run id").alias("fault")))


def write_run(r: DataFrame, path: str, run_id: str) -> None:
    """query Q0 doc rank score id, ordered by query and rank."""
    _text(r, F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", "rank", F.format_string("%f", F.col("score").cast("double")), F.lit(run_id)), path, ["query_id", "rank"])


# --- features, weights, vectors ---------------------------------------------------------


def features(spark: SparkSession, path) -> DataFrame:
    """query_id, grade, feats (array; absent features are null), from 'grade qid:q 1:v 2:v # note'."""
    x = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("v")).filter("v <> ''").select(F.split("v", " +").alias("f"))
    pairs = F.transform(F.slice("f", F.lit(3), F.size("f")), lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    table = F.map_from_entries(pairs)
    top = F.array_max(F.map_keys(table))
    return x.select(F.regexp_extract(F.col("f")[1], "^qid:(.*)$", 1).alias("query_id"), F.col("f")[0].cast("double").alias("grade"), F.transform(F.sequence(F.lit(1), top), lambda k: F.element_at(table, k)).alias("feats"))


def write_features(df: DataFrame, path: str) -> None:
    """Rows query_id, grade, feats; features count from 1."""
    pairs = F.transform("feats", lambda v, k: F.concat((k + 1).cast("string"), F.lit(":"), v.cast("string")))
    _text(df, F.concat_ws(" ", F.format_string("%.0f", F.col("grade").cast("double")), F.concat(F.lit("qid:"), "query_id"), F.array_join(pairs, " ")), path, ["query_id"])


def weights(spark: SparkSession, path) -> list[float]:
    """A linear model: 1:w 2:w ..., ids without gaps, # lines dropped. A few numbers: driver side."""
    rows = spark.read.text(path).filter(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != "")).select(F.split(F.trim("value"), BLANK).alias("f")).collect()
    got = {int(k): float(v) for r in rows for k, v in (x.split(":") for x in r.f)}
    if sorted(got) != list(range(1, len(got) + 1)):
        raise ValueError("weight ids must run from 1 without gaps")
    return [got[k] for k in sorted(got)]


def write_weights(spark: SparkSession, w: list[float], path: str) -> None:
    spark.createDataFrame([(" ".join(f"{k}:{v}" for k, v in enumerate(w, 1)),)], "value string").coalesce(1).write.text(path)


def embeddings(spark: SparkSession, path, normalize: bool = True) -> DataFrame:
    """word, v of 'word x1 x2 ...'; one row a word; vectors of length 1."""
    x = fields(spark, path).select(_part(0).alias("word"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda v: v.cast("double")).alias("v"))
    x = x.groupBy("word").agg(F.first("v").alias("v"))
    dims = x.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if dims.lo != dims.hi:
        raise ValueError(f"vectors of {dims.lo} to {dims.hi} dimensions")
    if not normalize:
        return x
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
    return x.withColumn("v", F.when(n > 0, F.transform("v", lambda y: y / n)).otherwise(F.col("v")))


# --- words, training data, translation --------------------------------------------------


def stop_words(spark: SparkSession, path, lower: bool = True) -> DataFrame:
    w = F.trim("value")
    return lines(spark, path).select((F.lower(w) if lower else w).alias("word")).distinct()


def dictionary(spark: SparkSession, path, lower: bool = False) -> DataFrame:
    return stop_words(spark, path, lower).filter(~F.startswith("word", F.lit("#")))


def training_texts(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Queries and documents of 'type\\tid\\ttext' lines; lines of other arity are skipped."""
    x = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") == 3)
    side = lambda kind: x.filter(_part(0) == kind).select(_part(1).alias("id"), _part(2).alias("text"))
    return side("query"), side("doc")


def training_pairs(spark: SparkSession, path) -> DataFrame:
    """query_id, doc_id, score (0 where absent) of tab-separated lines."""
    x = lines(spark, path).select(F.split(F.rtrim("value"), "\t").alias("f"))
    return x.select(_part(0).alias("query_id"), _part(1).alias("doc_id"), F.coalesce(F.try_element_at("f", F.lit(3)).cast("double"), F.lit(0.0)).alias("score"))


def write_training_texts(queries: DataFrame, docs: DataFrame, path: str) -> None:
    kind = lambda d, k: d.dropDuplicates(["id"]).select(F.concat_ws("\t", F.lit(k), "id", F.regexp_replace("text", "[\\t\\n\\r]+", " ")).alias("value"))
    kind(queries, "query").unionByName(kind(docs, "doc")).write.text(path)


def translation_vocabulary(spark: SparkSession, path, keep: DataFrame | None = None) -> DataFrame:
    """id, word, p: shares are of all rows, the filter (word) comes after."""
    x = fields(spark, path, 3).select(_part(0, "int").alias("id"), _part(1).alias("word"), _part(2, "double").alias("n"))
    x = x.crossJoin(F.broadcast(x.agg(F.sum("n").alias("_all")))).select("id", "word", (F.col("n") / F.col("_all")).alias("p"))
    return x if keep is None else x.join(keep.select("word"), "word", "left_semi").select("id", "word", "p")


def translation_table(spark: SparkSession, path, src: DataFrame, dst: DataFrame) -> DataFrame:
    """src, dst (words), p; ids that a vocabulary lacks are dropped, id 0 is the null word."""
    null = spark.createDataFrame([(0, "<null>")], "id int, word string")
    x = fields(spark, path, 3).select(_part(0, "int").alias("s"), _part(1, "int").alias("d"), _part(2, "double").alias("p"))
    a = src.select("id", "word").unionByName(null).select(F.col("id").alias("s"), F.col("word").alias("src"))
    return x.join(a, "s").join(dst.select(F.col("id").alias("d"), F.col("word").alias("dst")), "d").select("src", "dst", "p")


# --- collections ------------------------------------------------------------------------


def xml_records(spark: SparkSession, path, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def cranfield(spark: SparkSession, path) -> DataFrame:
    """id, title, author, source, body of '.I n' records with .T .A .B .W sections. Records are
    split by Spark's own line separator, so a file is read in pieces."""
    x = spark.read.option("lineSep", "\n.I ").text(path).select(F.regexp_replace("value", "^\\.I ", "").alias("r")).filter(F.trim("r") != "")
    part = lambda k: F.trim(F.regexp_replace(F.regexp_extract("r", f"(?s)\\n\\.{k} *\\n(.*?)(?=\\n\\.[A-Z] *\\n|$)", 1), "[\\n\\r]+", " "))
    return x.select(F.trim(F.split("r", "\n")[0]).cast("int").alias("id"), part("T").alias("title"), part("A").alias("author"), part("B").alias("source"), part("W").alias("body"))


def json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """Objects of files that are one JSON array each: by ranges, or, compressed, a task a file."""
    from ranklode.sources import ranges

    if isinstance(path, str) and not path.endswith((".gz", ".bz2", ".zst", ".xz")):
        return ranges.json_objects(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)
