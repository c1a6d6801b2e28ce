"""Streams of documents and events. Tokenising and matching are stateless and the same as in
batch; repeated events fall away within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.session import bounded


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, w, doc_len of a stream (or table) of documents."""
    return docs.select("doc_id", T.tokens("text").alias("w")).withColumn("doc_len", F.size("w"))


def matched(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, hits: queries (static query_id, word) whose words a new document has."""
    return tokenized(docs).select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(bounded(terms), "word")


def first_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
