"""Session helpers: tables, worker import path, shared folder, bounded batches."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

ROOT = str(Path(__file__).resolve().parent.parent)
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Local masters share the file system, so the workers' PYTHONPATH is enough;
    elsewhere a zip of the package goes out once through ``addPyFile``.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if not sc.master.startswith("local") and not getattr(sc, "_ranklode_zip", None):
        path = os.path.join(tempfile.mkdtemp(), "ranklode.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in Path(ROOT, "ranklode").rglob("*.py"):
                z.write(p, str(p.relative_to(ROOT)))
        sc.addPyFile(path)
        sc._ranklode_zip = path
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    if int(rows or 0) <= 0 or int(rows) > BATCH_ROWS:  # documents can be long: few a batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Folders that this process has made below the shared one, oldest first.
_made: list[str] = []


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below the folder that driver and executors share, with its scheme.

    The folder comes from ``spark.checkpoint.dir``; a path without scheme is one of the
    cluster's default file system, which may be a folder mounted on every machine. Only on one
    machine (tests) does a local folder stand in for it. What is written there is removed by ``clean``, at the latest when the driver ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        hadoop = sc._jsc.sc().getCheckpointDir()
        if hadoop.isDefined():
            base = hadoop.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            base = f"file://{tempfile.gettempdir()}/ranklode-shared"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _made:
        atexit.register(_clean, sc._jvm, sc._jsc.hadoopConfiguration(), _made)
    path = qualified(spark, f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: without one, it is a path of the cluster's default file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    x = jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/(?!/)", "file:///", x.getFileSystem(conf).makeQualified(x).toString())


def _clean(jvm, conf, paths: list[str]) -> None:
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the folders made since there were so many (``made``), but for that of a table that
    ``cut`` has returned. Tables that read the others can't be read any more."""
    stays = getattr(keep, "_folder", None)
    gone = [p for p in _made[since:] if p != stays]
    _made[since:] = [p for p in _made[since:] if p == stays]
    sc = spark.sparkContext
    _clean(sc._jvm, sc._jsc.hadoopConfiguration(), gone)


def made() -> int:
    return len(_made)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts the
    lineage, and a lost executor takes nothing with it."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


#: Written tables of at most so many bytes, and so many in memory, are broadcast.
BROADCAST_BYTES, BROADCAST_WHOLE = 8 << 20, 128 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The table, written once, with a broadcast hint if it is small; beyond that Spark's own join
    takes over. What its rows are in memory is summed up while they are written: texts that
    repeat take little of a file."""
    plain = (NumericType, BooleanType, DateType, TimestampType)
    long = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, plain)]
    size = sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) for c in long), F.lit(16 * len(df.columns)))
    seen = Observation()
    x = cut(df.observe(seen, F.sum(size.cast("long")).alias("bytes")), "side")
    return F.broadcast(x) if written_bytes(x) <= BROADCAST_BYTES and (seen.get["bytes"] or 0) <= BROADCAST_WHOLE else x


def written_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table that ``cut`` has returned."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def forget(*tables: DataFrame) -> None:
    """Remove the folders of tables that ``cut`` has returned and nothing reads any more."""
    for t in tables:
        path = getattr(t, "_folder", None)
        if path in _made:
            _made.remove(path)
            sc = t.sparkSession.sparkContext
            _clean(sc._jvm, sc._jsc.hadoopConfiguration(), [path])


#: A part of ``dealt`` holds what so many bytes of the inputs' files give.
PART_BYTES, MOST_PARTS = 8 << 20, 20_000


def parts(*tables: DataFrame) -> int:
    """Parts that the input of these tables is dealt into: by its size, so that a task's share of rows,
    sorted or grouped in memory, stays the same however large the input is."""
    size = 0
    for t in tables:
        leaves = t._jdf.queryExecution().optimizedPlan().collectLeaves()
        known = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
        size = max(size, sum(n for n in known if n < 1 << 60))  # tables that aren't files say that they are endless
    spark = tables[0].sparkSession
    return min(MOST_PARTS, max(min(n_shuffle(spark), spark.sparkContext.defaultParallelism), -(-size // PART_BYTES)))


def dealt(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Rows by keys in as many parts as the input's size asks for (``parts``), which are not put together again."""
    return df.repartition(n or parts(df), *keys)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
