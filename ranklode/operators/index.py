"""Indexes of a text field: tokens, postings, vocabulary, statistics, positions.

Everything is one pass over the text with map-side combination; a field's postings are
(doc_id, word, tf, doc_len). ``stored`` writes the words of each document once, so that nothing
that follows takes texts apart again, and only the columns it needs are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.operators.ordering import numbered
from ranklode.session import bounded, cut, dealt


@dataclass
class Index:
    docs: DataFrame  # doc_id, w (its words), doc_len
    texts: DataFrame | None = None  # doc_id, text, if nothing is stored

    @property
    def by_document(self) -> Index:
        """The index dealt by doc_id: what is grouped by document isn't shuffled word by word, but as whole texts."""
        return Index(dealt(self.docs, "doc_id") if self.texts is None else _split(dealt(self.texts, "doc_id")))

    @property
    def tokens(self) -> DataFrame:
        """doc_id, pos (from 0), word."""
        return self.docs.select("doc_id", "doc_len", F.posexplode("w").alias("pos", "word"))

    @property
    def occurrences(self) -> DataFrame:
        """word, tf (1) of each place: enough for sums over a collection, without grouping by document."""
        return self.docs.select(F.explode("w").alias("word"), F.lit(1.0).alias("tf"))

    @property
    def postings(self) -> DataFrame:
        return self.by_document.docs.select("doc_id", "doc_len", F.explode("w").alias("word")).groupBy("doc_id", "word").agg(F.first("doc_len").alias("doc_len"), F.count("*").cast("double").alias("tf"))

    def postings_of(self, words: DataFrame) -> DataFrame:
        """doc_id, word, tf, doc_len of the given words (word), taken from the texts' words."""
        asked = bounded(words.select("word").distinct())
        hits = self.docs.select("doc_id", "doc_len", F.explode("w").alias("word")).join(asked, "word")
        return hits.groupBy("doc_id", "word").agg(F.first("doc_len").alias("doc_len"), F.count("*").cast("double").alias("tf"))

    def frequencies(self, postings: DataFrame) -> DataFrame:
        """word, df of the words of these postings, which are all of theirs."""
        return postings.groupBy("word").agg(F.count("*").cast("double").alias("df"))

    @property
    def stats(self) -> DataFrame:
        return self.docs.agg(F.count("*").cast("double").alias("n_docs"), F.sum("doc_len").alias("total_words"), F.avg("doc_len").alias("avgdl"))

    @cached_property
    def figures(self) -> Row:
        """``stats`` on the driver: three numbers, read once."""
        return self.stats.first()

    @property
    def vocab(self) -> DataFrame:
        """word, df, cf, idf. Words are counted once a document before anything is shuffled."""
        once = self.docs.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").cast("double").alias("df"))
        return once.crossJoin(F.broadcast(self.stats.select("n_docs"))).select("word", "df", idf("df", "n_docs").alias("idf"))


def idf(df="df", n="n_docs"):
    df, n = T.col(df), T.col(n)
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def ranking_idf(df="df", n="n_docs"):
    """The form that ranking models take: never negative."""
    df, n = T.col(df), T.col(n)
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))


def build(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> Index:
    texts = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))
    return Index(_split(texts), texts)


def _split(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", T.tokens("text").alias("w")).withColumn("doc_len", F.size("w").cast("double"))


def stored(idx: Index) -> Index:
    """The index, written to the shared folder."""
    return Index(cut(idx.docs, "index"))


def query_terms(queries: DataFrame, id_: str = "item_id", text: str = "text") -> DataFrame:
    """query_id, word, qtf."""
    return queries.select(F.col(id_).alias("query_id"), F.explode(T.tokens(text)).alias("word")).groupBy("query_id", "word").agg(F.count("*").cast("double").alias("qtf"))


def frequent_words(vocab: DataFrame, k: int) -> DataFrame:
    """Words at least as frequent as the k-th; ties stay."""
    floor = vocab.select("df").orderBy(F.desc("df")).limit(k).agg(F.min("df").alias("_least"))
    return vocab.join(F.broadcast(floor), F.col("df") >= F.col("_least")).drop("_least")


def vocabulary_counts(idx: Index) -> DataFrame:
    """word, total (occurrences), docs."""
    return idx.postings.groupBy("word").agg(F.sum("tf").alias("total"), F.count("*").alias("docs"))


def with_word_ids(vocab: DataFrame) -> DataFrame:
    """Ids from 1 in order of the words, which are dealt by ranges."""
    return numbered(vocab, "word", name="word_id").withColumn("word_id", F.col("word_id").cast("int"))


def rebuilt_text(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("text"))
