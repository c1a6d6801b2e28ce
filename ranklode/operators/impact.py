"""An index that is kept on disk, and a top-k that leaves out blocks below the k-th score.

Below its path an index has ``docs`` (each document's words, for what needs positions), ``figures``
(one row: documents, words, BM25's settings), ``words`` (how many documents have each) and ``blocks``. Documents are dealt into ranges of some
``RANGE_DOCS`` by a hash of their id; a block holds a word's postings of one range, with the
largest BM25 factor among them. Blocks lie in buckets of words, sorted by word and then by that
impact, largest first: a query reads the buckets and row groups of its words only, and of those first
the impacts alone.

What a range can add to a query is at most the sum of its words' block impacts by their weights.
``Ranking`` scores the ranges with the highest bounds first (k a query, each of which has a match, or ``AHEAD``), takes the k-th
score so far, and then the ranges whose bounds reach it. All blocks of a range and query are scored
together, so scores are whole and results the same as without bounds. In an index of fewer than
``LEAST_RANGES`` ranges bounds cost more than they save: all blocks of the queries' words are scored
in one pass, unless ``prune`` says otherwise. The fewer words queries have, the more is left out.

Building reads texts once and shuffles the documents by range; a range's words are counted and packed into
blocks in one pass over Arrow batches. Blocks are then dealt by bucket and, in large indexes, slices of ranges, and sorted by word and impact
within each, so that a word that a third of all documents have fills many tasks and no single one. Rows of one doc_id are one document; a null text has no words
and no posting, but counts as a document. An empty table gives an index without blocks.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ranklode.operators import candidates as C
from ranklode.operators.index import Index, idf
from ranklode.session import bounded, cut, dealt, parts, shared_dir, ship

RANGE_DOCS, BUCKETS, AHEAD, LEAST_RANGES = 128, 16, 2, 1_000
#: Row groups are small, so that those of other words can be left out.
GROUP_BYTES = 4 << 20
#: A bucket is one slice for so many parts that the documents' words are dealt into (``session.parts``): some 64 MB.
SLICE_PARTS = 8
#: Up to so many words are told to the scan itself.
PUSHED_WORDS = 100


def bucket(word) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _schema(docs: DataFrame) -> str:
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return f"word string, range int, impact double, n int, postings array<struct<doc_id:{doc_id},tf:double,doc_len:double>>"


def _blocks(avgdl: float, k1: float, b: float):
    """Rows (range, doc_id, doc_len, w) sorted by range to blocks. A range's counts are kept until its last batch."""
    keys = ["range", "word", "doc_id"]

    def counted(t: pa.Table) -> pa.Table:
        got = t.group_by(keys, use_threads=False).aggregate([("doc_len", "max"), ("tf", "sum")])
        return got.select([*keys, "doc_len_max", "tf_sum"]).rename_columns([*keys, "doc_len", "tf"])

    def split(batch: pa.RecordBatch) -> pa.Table:
        at, words = pc.list_parent_indices(batch.column("w")), pc.list_flatten(batch.column("w"))
        of = {c: batch.column(c).take(at) for c in ("range", "doc_id", "doc_len")}
        return counted(pa.table({"range": of["range"], "word": words, "doc_id": of["doc_id"], "doc_len": of["doc_len"], "tf": pa.array(np.ones(len(at)))}))

    def packed(t: pa.Table) -> pa.RecordBatch:
        words, r = t.column("word").combine_chunks().dictionary_encode(), t.column("range").to_numpy()
        key = r.astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        tf, length = (t.column(c).to_numpy() for c in ("tf", "doc_len"))
        most = np.maximum.reduceat((tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl)))[order], starts)
        rows = pa.array(order)
        postings = pa.StructArray.from_arrays([t.column(c).combine_chunks().take(rows) for c in ("doc_id", "tf", "doc_len")], ["doc_id", "tf", "doc_len"])
        ends = np.append(starts, len(order)).astype(np.int32)
        first = order[starts]
        columns = [words.dictionary.take(words.indices.take(pa.array(first))), pa.array(r[first], pa.int32()), pa.array(most), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), postings)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "range", "impact", "n", "postings"])

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = split(batch)
            here = here if left is None else counted(pa.concat_tables([left, here]))
            open_ = pc.equal(here.column("range"), batch.column("range")[-1])
            left, done = here.filter(open_), here.filter(pc.invert(open_))
            if len(done):
                yield packed(done)
        if left is not None and len(left):
            yield packed(left)

    return run


def build(idx: Index, path: str, k1: float = C.K1, b: float = C.B) -> Impact:
    """Write the index of ``idx`` below ``path`` and open it."""
    spark = idx.docs.sparkSession
    ship(spark)
    idx.docs.write.parquet(f"{path}/docs")
    docs = spark.read.schema(idx.docs.schema).parquet(f"{path}/docs")
    whole = Index(docs)
    figures = whole.stats.select("*", F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.greatest(F.ceil(F.col("n_docs") / RANGE_DOCS), F.lit(1)).cast("int").alias("ranges"))
    figures.write.parquet(f"{path}/figures")
    f = spark.read.parquet(f"{path}/figures").first()
    ranged = dealt(docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(f.ranges)).cast("int").alias("range"), "doc_id", "doc_len", "w"), "range", n=parts(docs)).sortWithinPartitions("range")
    blocks = ranged.mapInArrow(_blocks(f.avgdl, k1, b), _schema(docs)).withColumn("bucket", bucket("word"))
    slices = max(1, -(-parts(docs) // (SLICE_PARTS * BUCKETS)))
    at = F.col("bucket") * slices + F.pmod("range", F.lit(slices))
    blocks = blocks.repartitionById(BUCKETS * slices, at.cast("int")).sortWithinPartitions("bucket", "word", F.desc("impact"), "range")
    blocks.write.partitionBy("bucket").option("parquet.block.size", str(GROUP_BYTES)).parquet(f"{path}/blocks")
    out = Impact(spark, path)
    out.blocks.groupBy("word").agg(F.sum("n").cast("double").alias("df")).write.parquet(f"{path}/words")
    return out


class Impact(Index):
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark.read.parquet(f"{path}/docs"))
        self.spark, self.path = spark, path

    @cached_property
    def figures(self) -> Row:
        return self.spark.read.parquet(f"{self.path}/figures").first()

    @cached_property
    def words(self) -> DataFrame:
        """word, df."""
        return self.spark.read.schema("word string, df double").parquet(f"{self.path}/words")

    @property
    def vocab(self) -> DataFrame:
        return self.words.select("word", "df", idf("df", F.lit(self.figures.n_docs)).alias("idf"))

    def frequencies(self, postings: DataFrame) -> DataFrame:
        return self.words

    @cached_property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{_schema(self.docs)}, bucket int").parquet(f"{self.path}/blocks")

    def blocks_of(self, words: DataFrame) -> DataFrame:
        """The blocks of the given words (word): few words, and their buckets, are told to the scan."""
        asked = bounded(words.select("word").filter("word is not null").distinct())
        some = [r.word for r in asked.limit(PUSHED_WORDS + 1).collect()]
        x = self.blocks
        if len(some) <= PUSHED_WORDS:
            there = [r.b for r in asked.select(bucket("word").alias("b")).distinct().collect()]
            x = x.filter(F.col("bucket").isin(there) & F.col("word").isin(some)) if some else x.limit(0)
        return x.drop("bucket").join(asked, "word", "left_semi")

    def postings_of(self, words: DataFrame) -> DataFrame:
        x = self.blocks_of(words).select("word", F.inline("postings"))
        return x.select("doc_id", "word", "tf", "doc_len")

    @property
    def postings(self) -> DataFrame:
        return self.blocks.select("word", F.inline("postings")).select("doc_id", "doc_len", "word", "tf")


class Ranking:
    """The best k documents of each query (``run``), and what it took (``share``)."""

    def __init__(self, idx: Impact, terms: DataFrame, k: int, prune: bool | None = None):
        f = idx.figures
        self.weights = bounded(C.weighed(idx, terms, None))
        blocks = idx.blocks_of(self.weights).join(self.weights, "word").withColumn("_w", F.col("qtf") * F.col("idf"))
        factor = C.norm_tf(avgdl=F.lit(f.avgdl), k1=f.k1, b=f.b)
        scored = lambda x: x.select("query_id", "_w", F.inline("postings")).groupBy("query_id", "doc_id").agg(F.sum(F.col("_w") * factor).alias("score"))
        if prune is None:
            prune = f.ranges >= LEAST_RANGES
        bound = blocks.groupBy("query_id", "range").agg(F.sum(F.col("_w") * F.col("impact")).alias("most"), F.count("*").alias("blocks"))
        if not prune:
            self.bounds = self.read = bound
            self.run = cut(C.top(scored(blocks), k), "run")
            return
        self.bounds = cut(bound, "bounds")
        of = lambda ranges: scored(blocks.join(ranges.select("query_id", "range"), ["query_id", "range"]))
        first = Window.partitionBy("query_id").orderBy(F.desc("most"), "range")
        ahead = bounded(self.bounds.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= max(AHEAD, k)).drop("_at"))
        some = cut(C.top(of(ahead), k), "some")
        floor = some.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_floor"))
        # Scores are compared by six decimals; sums differ in their last bits.
        rest = self.bounds.join(ahead.select("query_id", "range"), ["query_id", "range"], "left_anti").join(floor, "query_id", "left")
        rest = bounded(rest.filter("_floor is null or most * (1 + 1e-12) + 1e-6 >= _floor").drop("_floor"))
        self.read = ahead.unionByName(rest)
        self.run = cut(C.top(some.select("query_id", "doc_id", "score").unionByName(of(rest)), k), "run")

    def share(self) -> DataFrame:
        """query_id, blocks of its words, and how many of them were scored."""
        every = self.bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
        return every.join(self.read.groupBy("query_id").agg(F.sum("blocks").alias("scored")), "query_id")


#: Indexes of this process: (application, table, settings) to (files of the table, folder).
_kept: dict[tuple, tuple] = {}


def kept(spark: SparkSession, table: str, what: str, make) -> Impact:
    """The index of a table's files that this process has built before, if they are as they
    were, or else ``make()`` of it, built now. It is opened by its path: no text is read again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(path)
    stamp = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))
    key = (spark.sparkContext.applicationId, table, what)
    if key in _kept and _kept[key][0] == stamp:
        folder = hadoop.Path(f"{_kept[key][1]}/blocks/_SUCCESS")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return Impact(spark, _kept[key][1])
    where = shared_dir(spark, "impact")
    out = build(make(), where)
    _kept[key] = (stamp, where)
    return out
