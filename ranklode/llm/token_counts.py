"""Token counts of documents in flat token files, by a scan for separators.

A flat file is little-endian 16-bit token ids, document after document, each closed by an
end-of-document id; it has no index. Files are cut into blocks of a fixed size, wherever that
falls. Each block is searched for the separator with one vectorised comparison and keeps only
the places found. A prefix scan over the blocks of a file then gives each block what lies before
it: how many documents have ended, and where the last separator was. With that, every block
finishes the documents that end in it, also those that began blocks earlier.

What stands behind a file's last separator is an unclosed document; it is returned with
``closed`` false. A document without tokens has count 0. Odd bytes at a file's end are an error.

``write`` tokenises documents into such files (one for each task, ids beside them in a file of
64-bit numbers with a mark for null, in the same order). The tokenizer's model is a parameter; its end-of-document id
must be one that no text can give. Null texts have no tokens. Rows with null or equal doc_ids
are counted one by one. Empty tables give no file and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ranklode.llm import kernels as K
from ranklode.llm import store
from ranklode.session import shared_dir, ship

MODEL, END = "/opt/tokenizers/piece_bpe_32k.model", 2
BLOCK_BYTES = 8 << 20
DTYPE = np.dtype("<u2")
ID = np.dtype([("id", "<i8"), ("null", "?")])


# --- writing ----------------------------------------------------------------------------


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.model, self.end = options["path"], options["model"], int(options["end"])

    def write(self, iterator):
        import sentencepiece

        tokens = sentencepiece.SentencePieceProcessor(model_file=self.model)
        if tokens.vocab_size() > 1 << 16:
            raise ValueError("token ids need more than 16 bits")
        out = ids = None
        size = docs = 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                name, out = store.create(self.path, ".tokens")
                id_name, ids = store.create(self.path, ".ids")
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 64):
                for t in tokens.encode(texts[at : at + 64], num_threads=1):
                    if self.end in t:
                        raise ValueError("a text holds the end-of-document id")
                    t.append(self.end)
                    data = np.array(t, DTYPE).tobytes()
                    out.write(data)
                    size += len(data)
            record = np.empty(batch.num_rows, ID)
            record["id"], record["null"] = K.ids(batch.column("doc_id"))
            ids.write(record.tobytes())
            docs += batch.num_rows
        if out is None:
            return _Written([])
        out.close()
        ids.close()
        return _Written([{"name": name, "size": size}, {"name": id_name, "size": ID.itemsize * docs, "of": name}])

    def commit(self, messages):
        store.commit(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages):
        store.remove(self.path, [f["name"] for m in messages if m for f in m.files])


# --- scanning ---------------------------------------------------------------------------


class _Block(InputPartition):
    def __init__(self, file, block, start, end):
        self.file, self.block, self.start, self.end = file, block, start, end


class TokenReader(DataSourceReader):
    """One row for each block: file, block, first token's place, tokens, places of separators."""

    def __init__(self, options):
        self.path, self.end = options["path"], int(options["end"])
        self.bytes = int(options.get("block_bytes", BLOCK_BYTES)) // 2 * 2

    def partitions(self):
        out = []
        for f in store.listing(self.path, (".tokens",)):
            if f["name"].endswith(".ids"):
                continue
            if f["size"] % 2:
                raise ValueError(f"{f['name']}: half a token at the end")
            out += [_Block(f["name"], k, a, min(a + self.bytes, f["size"])) for k, a in enumerate(range(0, f["size"], self.bytes))]
        return out or [_Block(None, 0, 0, 0)]

    def read(self, p):
        if p.file is None:
            return
        with store.open_file(self.path, p.file) as f:
            f.seek(p.start)
            tokens = np.frombuffer(f.read(p.end - p.start), DTYPE)
        seps = np.flatnonzero(tokens == self.end).astype(np.int32)
        last = p.start // 2 + int(seps[-1]) if len(seps) else None
        yield pa.RecordBatch.from_pylist([{"file": p.file, "block": p.block, "first": p.start // 2, "tokens": len(tokens), "n_seps": len(seps), "last_sep": last, "seps": seps.tobytes()}], schema=_BLOCKS)


_BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("tokens", pa.int64()), ("n_seps", pa.int64()), ("last_sep", pa.int64()), ("seps", pa.binary())])
BLOCKS_DDL = "file string, block long, first long, tokens long, n_seps long, last_sep long, seps binary"
IDS_DDL = "file string, ordinal long, doc_id long"


class IdReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        step = BLOCK_BYTES // ID.itemsize * ID.itemsize
        out = [_Block(f["of"], f["name"], a, min(a + step, f["size"])) for f in store.manifest(self.path) or [] if "of" in f for a in range(0, f["size"], step)]
        return out or [_Block(None, 0, 0, 0)]

    def read(self, p):
        if p.file is None:
            return
        with store.open_file(self.path, p.block) as f:
            f.seek(p.start)
            ids = np.frombuffer(f.read(p.end - p.start), ID)
        at = np.arange(len(ids)) + p.start // ID.itemsize
        yield pa.RecordBatch.from_arrays([pa.array([p.file] * len(ids), pa.string()), pa.array(at), K.id_array(ids["id"].astype(np.int64), ids["null"])], names=["file", "ordinal", "doc_id"])


class FlatTokens(DataSource):
    @classmethod
    def name(cls):
        return "flat_tokens"

    def schema(self):
        return IDS_DDL if self.options.get("ids") else BLOCKS_DDL

    def reader(self, schema):
        return IdReader(self.options) if self.options.get("ids") else TokenReader(self.options)

    def writer(self, schema, overwrite):
        return TokenWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FlatTokens)


def write(docs: DataFrame, path: str, model: str = MODEL, end: int = END) -> None:
    register(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow.write.format("flat_tokens").mode("append").option("path", path).option("model", model).option("end", str(end)).save()


def scan(spark: SparkSession, path: str, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, n_tokens, closed of each document in the flat files below ``path``."""
    register(spark)
    blocks = spark.read.format("flat_tokens").option("path", path).option("end", str(end)).option("block_bytes", str(block_bytes)).load()
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n_seps").over(w), F.lit(0))).withColumn("open", F.coalesce(F.max("last_sep").over(w) + 1, F.lit(0)))
    blocks = blocks.withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    out = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("n_tokens", pa.int64()), ("closed", pa.bool_())])

    def finish(batches):
        for b in batches:
            for r in b.to_pylist():
                ends = r["first"] + np.frombuffer(r["seps"], np.int32).astype(np.int64)
                counts = np.diff(np.r_[r["open"] - 1, ends]) - 1
                closed = np.ones(len(counts), bool)
                tail = r["first"] + r["tokens"] - (int(ends[-1]) + 1 if len(ends) else r["open"])
                if r["is_last"] and tail:
                    counts, closed = np.r_[counts, tail], np.r_[closed, False]
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(counts), pa.string()), pa.array(r["before"] + np.arange(len(counts))), pa.array(counts, pa.int64()), pa.array(closed)], schema=out)

    return blocks.mapInArrow(finish, "file string, ordinal long, n_tokens long, closed boolean")


def ids(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("flat_tokens").option("path", path).option("ids", "true").load()


def counted(docs: DataFrame, model: str = MODEL, end: int = END) -> DataFrame:
    """doc_id, n_tokens of each document: written to flat files in the shared folder, scanned."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write(docs, path, model, end)
    found = scan(spark, path, end)
    return found.join(ids(spark, path), ["file", "ordinal"]).select("doc_id", "n_tokens", "closed")
