"""Candidate generation and ranked runs: (query_id, doc_id, score, rank).

Ranks are by score rounded to six decimals, then doc_id, both descending: sums of doubles
differ in their last bits from run to run, and a tie-break makes ranks reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.operators.containment import containing  # noqa: F401
from ranklode.operators.index import Index, idf
from ranklode.session import bounded, cut, dealt

K1, B = 1.2, 0.75


def top(scored: DataFrame, k: int, *keep: str) -> DataFrame:
    scored = scored.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", *keep)


def norm_tf(tf="tf", length="doc_len", avgdl="avgdl", k1: float = K1, b: float = B):
    tf, length, avgdl = map(T.col, (tf, length, avgdl))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def clean_query(c) -> Column:
    """A query's text without punctuation and without the operators of the query syntax."""
    return T.remove_operators(T.remove_punct(c))


def postings_of(idx: Index, words: DataFrame) -> DataFrame:
    """doc_id, word, tf, doc_len of the given words (word), written: documents' words meet them
    before they are counted, so only words that are asked for are shuffled."""
    return cut(idx.postings_of(words), "postings")


def weighed(idx: Index, terms: DataFrame, postings: DataFrame | None) -> DataFrame:
    """query_id, word, qtf, df, idf of the query words that some document has."""
    return terms.join(idx.frequencies(postings), "word").select("query_id", "word", "qtf", "df", idf(n=F.lit(idx.figures.n_docs)).alias("idf"))


def matches(idx: Index, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, word, qtf, tf, doc_len, df, idf, avgdl where a query's word is in a
    document. Document frequencies come from the same written postings."""
    hits = postings_of(idx, terms)
    return hits.join(bounded(weighed(idx, terms, hits)), "word").withColumn("avgdl", F.lit(idx.figures.avgdl))


def summed(matched: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    return matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * norm_tf(k1=k1, b=b)).alias("score"))


def bm25(idx: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    return summed(matches(idx, terms), k1, b)


def bm25_topk(idx: Index, terms: DataFrame, k: int = 10, **how) -> DataFrame:
    return top(bm25(idx, terms, **how), k)


def exact_match(docs: DataFrame, queries: DataFrame, field: str, k: int) -> DataFrame:
    """Documents whose field equals a query's key. Scores are all the same, so none but the ``k`` greatest
    ids of a key meet its queries."""
    last = Window.partitionBy(field).orderBy(F.desc("doc_id"))
    docs = docs.filter(F.col(field).isNotNull()).withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= k).drop("_r")
    return top(queries.select("query_id", F.col("key").alias(field)).join(docs, field).select("query_id", "doc_id", F.lit(1.0).alias("score")), k)


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot", drop_self: bool = False) -> DataFrame:
    """Nearest vectors, all compared; rows (id, v). See ``nearest``."""
    from ranklode.operators import nearest

    return nearest.knn(docs, queries, k, metric, drop_self)


def mapped(run: DataFrame, parents: DataFrame, k: int, how: str = "max") -> DataFrame:
    """Child scores to parents (child_id, parents: ids split by blanks), by max or sum."""
    p = parents.select(F.col("child_id").alias("doc_id"), F.explode(T.words("parents")).alias("_parent"))
    agg = {"max": F.max, "sum": F.sum}[how]
    return top(run.select("query_id", "doc_id", "score").join(p, "doc_id").groupBy("query_id", F.col("_parent").alias("doc_id")).agg(agg("score").alias("score")), k)


def hybrid(*runs: DataFrame) -> DataFrame:
    """Union of runs; the first run that has a pair gives its score."""
    every = None
    for n, run in enumerate(runs):
        x = run.select("query_id", "doc_id", F.struct(F.lit(n).alias("n"), F.col("score").alias("score")).alias("_s"))
        every = x if every is None else every.unionByName(x)
    return dealt(every, "query_id", "doc_id").groupBy("query_id", "doc_id").agg(F.min("_s")["score"].alias("score"))


def judged_only(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Lists of k that reach their first relevant document (its rank from 0 is at most k)."""
    hit = run.join(qrels.filter("grade > 0"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg((F.min("rank") - 1).alias("_at")).filter(F.col("_at") <= k)
    return run.filter(F.col("rank") <= k).join(hit, "query_id", "left_semi")


def tail_shifted(run: DataFrame, rescored: DataFrame, r: int) -> DataFrame:
    """The first r get new scores, the rest keep their distances below the least new score."""
    x = run.join(rescored.withColumnRenamed("score", "_new"), ["query_id", "doc_id"], "left")
    w = Window.partitionBy("query_id")
    new = F.when(F.col("rank") <= r, F.coalesce("_new", "score"))
    edge = F.min(F.when(F.col("rank") <= r, F.col("score"))).over(w)
    x = x.withColumn("_n", new).withColumn("_low", F.min("_n").over(w)).withColumn("_edge", edge)
    return x.select("query_id", "doc_id", F.coalesce("_n", F.col("_low") + F.col("score") - F.col("_edge")).alias("score"))


def with_fake(queries: DataFrame, run: DataFrame, fake: str = "FAKE_DOC") -> DataFrame:
    """Queries without results get one placeholder at rank 1 with score 0."""
    return queries.select("query_id").distinct().join(run, "query_id", "left").select("query_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(fake)).alias("doc_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.lit(1)).alias("rank"))


def first(df: DataFrame, id_: str, n: int) -> DataFrame:
    """The first n rows by id: the option that bounds queries or records."""
    return df.orderBy(id_).limit(n)
