"""Retrieval queries: index, candidates, similarities and features, metrics.

Documents are the collection, benchmark items the queries. Judgements: a document that holds an
item's text is relevant to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.functions import vectors as V
from ranklode.operators import candidates as C
from ranklode.operators import evaluate as E
from ranklode.operators import features as X
from ranklode.operators import impact as M
from ranklode.operators import index as I
from ranklode.operators import nearest as N
from ranklode.plans.registry import Tables, query
from ranklode.session import cut, dealt, shared_dir
from ranklode.sources import files as S

K = 10

# --- SQL building blocks ----------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda x: x <> '')"
DOCS = f"""
d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS word, len(w)::DOUBLE AS doc_len FROM d),
post AS MATERIALIZED (SELECT doc_id, word, count(*)::DOUBLE AS tf, any_value(doc_len) AS doc_len FROM tok GROUP BY ALL),
stats AS (SELECT count(*)::DOUBLE AS n_docs, sum(len(w))::DOUBLE AS total_words, avg(len(w)::DOUBLE) AS avgdl FROM d),
voc AS MATERIALIZED (SELECT word, count(*)::DOUBLE AS df, ln(1.0::DOUBLE + (n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, stats GROUP BY word, n_docs),
"""
TERMS = f"""
q AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark),
qt AS (SELECT query_id, word, count(*)::DOUBLE AS qtf FROM (SELECT query_id, unnest(w) AS word FROM q) GROUP BY ALL),
qpos AS (SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM q),
"""
NORM = "(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)))"
MATCH = f"""
m AS (SELECT query_id, doc_id, word, qtf, tf, idf, doc_len, {NORM} AS ntf FROM qt JOIN post USING (word) JOIN voc USING (word), stats),
bm AS (SELECT query_id, doc_id, sum(qtf * idf * ntf) AS s FROM m GROUP BY ALL),
run AS (SELECT query_id, doc_id, round(s, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id DESC))::INT AS rank FROM bm QUALIFY rank <= {K}),
"""
WT = "wt AS (SELECT query_id, word, qtf, df, idf FROM qt JOIN voc USING (word)), qi AS (SELECT query_id, sum(idf) AS idf_sum, sum(qtf) AS known, sum(qtf * qtf * idf * idf) AS q2 FROM wt GROUP BY ALL),"
RUN = DOCS + TERMS + MATCH
QRELS = "qrels AS (SELECT b.item_id AS query_id, d.doc_id, 1.0::DOUBLE AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text)),"


def index(t: Tables) -> I.Index:
    return I.build(t.documents)


def terms(t: Tables) -> DataFrame:
    return I.query_terms(t.benchmark)


def opened(t: Tables) -> M.Impact:
    """The documents' index: built by the first query that asks for it, then opened by its path."""
    return M.kept(t.spark, f"{t.dir}/documents.parquet", "text", lambda: index(t))


def run(t: Tables, k: int = K) -> DataFrame:
    return M.Ranking(opened(t), terms(t), k).run


def weighed(t: Tables, k: int = K) -> X.Weighed:
    """The index, the query words' postings and the run, each written once: texts are read once,
    and feature blocks share what they read."""
    return X.Weighed(opened(t), cut(terms(t), "terms"), k=k)


def stored(t: Tables, k: int = K) -> DataFrame:
    """A run written once."""
    return weighed(t, k).run


def query_tokens(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.posexplode(T.tokens("text")).alias("pos", "word"))


def qrels(t: Tables) -> DataFrame:
    return C.containing(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), "text")).withColumn("grade", F.lit(1.0))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- index ------------------------------------------------------------------------------


@query("SELECT doc_id, word, tf, doc_len FROM post", DOCS)
def k4_postings(t):
    return index(t).postings.select("doc_id", "word", "tf", "doc_len")


@query("SELECT word, df, round(idf, 6) AS idf FROM voc", DOCS)
def a2_vocabulary(t):
    return rounded(index(t).vocab, "idf")


@query("SELECT n_docs, total_words, round(avgdl, 6) AS avgdl FROM stats", DOCS)
def a3_statistics(t):
    return rounded(index(t).stats, "avgdl")


@query("SELECT word, sum(tf) AS total, count(*) AS docs FROM post GROUP BY word", DOCS)
def a4_vocabulary_counts(t):
    return I.vocabulary_counts(index(t))


@query("SELECT word, df FROM (SELECT word, df, rank() OVER (ORDER BY df DESC) AS r FROM voc) WHERE r <= 100", DOCS)
def p8_frequent_words(t):
    return I.frequent_words(index(t).vocab, 100).select("word", "df")


@query("SELECT word, (row_number() OVER (ORDER BY word))::INT AS word_id FROM voc", DOCS)
def k1_word_ids(t):
    return I.with_word_ids(index(t).vocab).select("word", "word_id")


@query("SELECT doc_id, unnest(w) AS word, (generate_subscripts(w, 1) - 1)::INT AS pos FROM d", DOCS)
def k1_positions(t):
    return index(t).tokens.select("doc_id", "word", "pos")


@query("SELECT doc_id, array_to_string(w, ' ') AS text FROM d WHERE len(w) > 0", DOCS)
def s29_rebuilt_text(t):
    return I.rebuilt_text(index(t).by_document.tokens)


@query("SELECT word, round(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.0::DOUBLE), 6) AS idf FROM voc, stats WHERE n_docs - df + 0.5 > df + 0.5", DOCS)
def f18_ranking_idf(t):
    idx = index(t)
    x = idx.vocab.drop("idf").crossJoin(F.broadcast(idx.stats.select("n_docs")))
    return rounded(x.select("word", I.ranking_idf().alias("idf")).filter("idf > 0"), "idf")


@query("SELECT doc_id FROM d WHERE len(w) = 0", DOCS)
def k1_empty_documents(t):
    return index(t).docs.filter("doc_len = 0").select("doc_id")


# --- candidates -------------------------------------------------------------------------


@query("SELECT query_id, doc_id, score, rank FROM run", RUN)
def c1_bm25_topk(t):
    return run(t)


@query("SELECT query_id, count(*) AS n_found, round(max(s), 6) AS best FROM bm GROUP BY query_id", RUN)
def c6_found(t):
    return rounded(C.bm25(index(t), terms(t)).groupBy("query_id").agg(F.count("*").alias("n_found"), F.max("score").alias("best")), "best")


@query("""SELECT query_id, doc_id, 1.0::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC))::INT AS rank
FROM (SELECT s_suppkey AS query_id, c_custkey AS doc_id FROM supplier JOIN customer ON c_nationkey = s_nationkey) QUALIFY rank <= 10""")
def c2_exact_match(t):
    docs = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("nation"))
    return C.exact_match(docs, t.supplier.select(F.col("s_suppkey").alias("query_id"), F.col("s_nationkey").alias("key")), "nation", 10)


EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),"
KNN = EMB + """
k AS (SELECT a.id AS query_id, b.id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
kr AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INT AS rank FROM k QUALIFY rank <= 10),
"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def knn_run(t: Tables) -> DataFrame:
    return C.knn(vectors(t), vectors(t).filter("id % 50 = 0"), 10, drop_self=True)


@query("SELECT a.id AS query_id, b.id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score, (row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.id DESC))::INT AS rank FROM e a JOIN e b ON a.id <> b.id QUALIFY rank <= 5", EMB)
def c3_knn_of_all(t):
    """The five nearest of every vector."""
    return C.knn(vectors(t), vectors(t), 5, drop_self=True)


@query(None)
def c3_cells(t):
    """Nearest vectors from the nearest cells of an inverted file; tests hold its recall."""
    return N.Cells(vectors(t), 16).search(vectors(t).filter("id % 50 = 0"), 10, 8, drop_self=True)


@query("SELECT query_id, doc_id, score, rank FROM kr", KNN)
def c3_knn(t):
    return knn_run(t)


@query("SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, score, rank FROM run WHERE rank <= 3", RUN)
def c4_stored_run(t):
    """A run file, written and read back; the first three of each query."""
    path = shared_dir(t.spark, "run")
    S.write_run(run(t).select(F.col("query_id").cast("string"), F.col("doc_id").cast("string"), "rank", "score"), path, "bm25")
    return S.run(t.spark, path).filter("rank <= 3").select("query_id", "doc_id", "score", "rank")


@query("SELECT query_id, doc_id, score, rank FROM run", "cleaned AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[!-/:-@\\[-`{-~]+', ' ', 'g'), '[ \\t\\n\\r\\f]+'), lambda x: x NOT IN ('', 'OR', 'AND', 'NOT', 'TO')), ' ') AS text FROM benchmark)," + RUN.replace("FROM benchmark", "FROM cleaned"))
def c1_cleaned_queries(t):
    """Punctuation and operators taken from the queries first, as a lexical provider does."""
    q = t.benchmark.select("item_id", C.clean_query("text").alias("text"))
    return M.Ranking(opened(t), I.query_terms(q), K).run


@query("SELECT word, doc_id, round(idf * ntf, 6) AS score, rank FROM (SELECT word, doc_id, idf, ntf, (row_number() OVER (PARTITION BY word ORDER BY round(idf * ntf, 6) DESC, doc_id DESC))::INT AS rank FROM (SELECT DISTINCT word, doc_id, idf, ntf FROM m)) WHERE rank <= 10", RUN)
def c1_word_champions(t):
    """The ten best documents of each word of the items, a query each: most blocks stay unread."""
    words = t.benchmark.select(F.explode(T.tokens("text")).alias("word")).distinct()
    return M.Ranking(opened(t), words.select(F.col("word").alias("query_id"), "word", F.lit(1.0).alias("qtf")), K, prune=True).run.withColumnRenamed("query_id", "word")


@query(None)
def k1_blocks_scored(t):
    """Of each item: blocks of its words, and those that its ten best documents took."""
    return M.Ranking(opened(t), terms(t), K, prune=True).share()


PARENTS = "par AS (SELECT doc_id, doc_id // 5 AS parent FROM documents),"


@query("""SELECT * FROM (SELECT query_id, parent AS doc_id, round(max(score), 6) AS score,
 (row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 6) DESC, parent DESC))::INT AS rank FROM run JOIN par USING (doc_id) GROUP BY query_id, parent) WHERE rank <= 5""", RUN + PARENTS)
def j5_parent_max(t):
    parents = t.documents.select(F.col("doc_id").alias("child_id"), F.floor(F.col("doc_id") / 5).cast("string").alias("parents"))
    x = C.mapped(run(t), parents, 1000)
    x = x.withColumn("doc_id", F.col("doc_id").cast("long"))
    return C.top(x, 5)


@query("""SELECT query_id, parent AS doc_id, round(sum(score), 6) AS score FROM run JOIN par USING (doc_id) GROUP BY query_id, parent""", RUN + PARENTS)
def a5_parent_sum(t):
    parents = t.documents.select(F.col("doc_id").alias("child_id"), F.floor(F.col("doc_id") / 5).cast("string").alias("parents"))
    return C.mapped(run(t), parents, 1000, "sum").select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "score")


L = "li AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), lr AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id DESC))::INT AS rank FROM li QUALIFY rank <= 3),"
LG = "lg AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(CASE WHEN l_quantity > 40 THEN 2.0 WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END)::DOUBLE AS grade FROM lineitem GROUP BY ALL),"


def line_run(t: Tables, k: int = 3) -> DataFrame:
    x = dealt(t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), "l_extendedprice"), "query_id")
    return C.top(x.groupBy("query_id", "doc_id").agg(F.max("l_extendedprice").alias("score")), k)


def line_grades(t: Tables) -> DataFrame:
    g = F.when(F.col("l_quantity") > 40, 2.0).when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)
    x = dealt(t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), g.alias("g")), "query_id")
    return x.groupBy("query_id", "doc_id").agg(F.max("g").alias("grade"))


@query("SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lr", L)
def l1_ranked_lines(t):
    return line_run(t)


@query("""SELECT k, count(*) AS n FROM lr JOIN (VALUES (1), (2), (3)) x(k) ON rank <= k GROUP BY k""", L)
def l4_several_sizes(t):
    return line_run(t).select(F.explode(F.sequence(F.col("rank"), F.lit(3))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lr WHERE rank <= 2 AND query_id IN
 (SELECT query_id FROM lr JOIN lg USING (query_id, doc_id) WHERE grade > 0 GROUP BY query_id HAVING min(rank) - 1 <= 2)""", L + LG)
def l5_judged_lists(t):
    return C.judged_only(line_run(t), line_grades(t), 2)


@query("""SELECT query_id, doc_id, round(CASE WHEN rank <= 2 THEN n ELSE min(CASE WHEN rank <= 2 THEN n END) OVER w + score - min(CASE WHEN rank <= 2 THEN score END) OVER w END, 6) AS score
FROM (SELECT *, CASE WHEN rank <= 2 THEN coalesce(g.grade, score) END AS n FROM lr LEFT JOIN lg g USING (query_id, doc_id)) WINDOW w AS (PARTITION BY query_id)""", L + LG)
def l6_tail_shift(t):
    return rounded(C.tail_shifted(line_run(t), line_grades(t).withColumnRenamed("grade", "score"), 2), "score")


@query("""SELECT query_id, doc_id, round(arg_min(score, n), 6) AS score FROM (
 SELECT query_id, doc_id, score, 0 AS n FROM lr WHERE rank <= 2 UNION ALL SELECT query_id, doc_id, grade, 1 FROM lg) GROUP BY ALL""", L + LG)
def u1_hybrid_run(t):
    return rounded(C.hybrid(line_run(t).filter("rank <= 2"), line_grades(t).withColumnRenamed("grade", "score")), "score")


@query("""SELECT query_id, coalesce(doc_id::VARCHAR, 'FAKE_DOC') AS doc_id, coalesce(score, 0.0) AS score, coalesce(rank, 1)::INT AS rank FROM (SELECT c_custkey AS query_id FROM customer) LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM (SELECT o_custkey AS query_id, o_orderkey AS doc_id, round(o_totalprice, 6) AS score FROM orders) QUALIFY rank <= 3) USING (query_id)""")
def k5_run_with_fake(t):
    orders = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    return C.with_fake(t.customer.select(F.col("c_custkey").alias("query_id")), C.top(orders, 3))


# --- similarities and features ----------------------------------------------------------


@query(f"SELECT query_id, doc_id, {r('bm25', 'bm25_norm')} FROM (SELECT query_id, doc_id, s AS bm25, s / idf_sum AS bm25_norm FROM run JOIN bm USING (query_id, doc_id) JOIN qi USING (query_id))", RUN + WT)
def x1_bm25(t):
    return rounded(X.bm25(weighed(t)), "bm25", "bm25_norm")


@query("""SELECT query_id, doc_id, round(up / sqrt(greatest(1e-6::DOUBLE, d2 * q2)), 6) AS cosine FROM (SELECT query_id, doc_id, sum(qtf * tf * idf * idf) AS up FROM m JOIN run USING (query_id, doc_id) GROUP BY ALL)
 JOIN (SELECT doc_id, sum(tf * tf * idf * idf) AS d2 FROM post JOIN voc USING (word) GROUP BY ALL) USING (doc_id) JOIN qi USING (query_id)""", RUN + WT)
def x1_cosine(t):
    return rounded(X.cosine_tfidf(weighed(t)), "cosine")


@query("SELECT query_id, doc_id, round(sum(qtf) / greatest(any_value(known), 1.0), 6) AS overlap FROM m JOIN run USING (query_id, doc_id) JOIN qi USING (query_id) GROUP BY ALL", RUN + WT)
def x2_overlap(t):
    return rounded(X.overlap(weighed(t)), "overlap")


PAIR_SQL = """
qw AS (SELECT query_id, pos, word, idf FROM qpos JOIN voc USING (word)),
near AS (SELECT a.query_id, a.word AS w1, b.word AS w2, (a.idf + b.idf) / 2 AS idf FROM qw a JOIN qw b ON a.query_id = b.query_id AND a.pos < b.pos AND b.pos < a.pos + 4 AND a.word <> b.word),
dp AS (SELECT doc_id, len(w)::DOUBLE AS doc_len, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d WHERE doc_id IN (SELECT doc_id FROM run)),
qd AS (SELECT query_id, doc_id, doc_len, pos, word FROM dp JOIN run USING (doc_id) SEMI JOIN qt USING (query_id, word)),
tog AS (SELECT a.query_id, a.doc_id, a.doc_len, a.word AS w1, b.word AS w2 FROM qd a JOIN qd b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.pos < b.pos AND b.pos < a.pos + 8 AND a.word <> b.word),
"""


def _pair(a: str, b: str, name: str) -> str:
    return f"""(SELECT query_id, doc_id, sum(idf * {NORM}) AS {name} FROM (SELECT query_id, doc_id, any_value(doc_len) AS doc_len, {a} AS a, {b} AS b, count(*)::DOUBLE AS tf FROM tog GROUP BY query_id, doc_id, {a}, {b})
 JOIN (SELECT query_id, {a} AS a, {b} AS b, any_value(idf) AS idf FROM near GROUP BY query_id, {a}, {b}) USING (query_id, a, b), stats GROUP BY query_id, doc_id)"""


@query(f"""SELECT query_id, doc_id, round(coalesce(o, 0) / idf_sum, 6) AS ordered, round(coalesce(u, 0) / idf_sum, 6) AS unordered FROM run JOIN qi USING (query_id)
 LEFT JOIN {_pair('w1', 'w2', 'o')} USING (query_id, doc_id) LEFT JOIN {_pair('least(w1, w2)', 'greatest(w1, w2)', 'u')} USING (query_id, doc_id)""", RUN + WT + PAIR_SQL)
def x3_close_pairs(t):
    return rounded(X.close_pairs(weighed(t), query_tokens(t)), "ordered", "unordered")


@query("""SELECT query_id, doc_id, round(coalesce(i, 0), 6) AS independent, round(coalesce(o, 0), 6) AS ordered FROM run
LEFT JOIN (SELECT query_id, doc_id, sum(qtf * ln((tf + 1) / (doc_len + 1))) AS i FROM m GROUP BY ALL) USING (query_id, doc_id)
LEFT JOIN (SELECT query_id, doc_id, sum(ln((coalesce(n, 0) + 1) / (doc_len + 1))) AS o FROM run JOIN succ USING (query_id) JOIN (SELECT doc_id, len(w)::DOUBLE AS doc_len FROM d) USING (doc_id)
  LEFT JOIN (SELECT query_id, doc_id, word, count(*) AS n FROM nb JOIN succ USING (query_id, word, s) GROUP BY ALL) USING (query_id, doc_id, word) GROUP BY ALL) USING (query_id, doc_id)""",
RUN + """qn AS (SELECT query_id, word, pos, lead(word) OVER (PARTITION BY query_id ORDER BY pos) AS s FROM qpos), succ AS (SELECT query_id, word, arg_max(s, pos) AS s FROM qn WHERE s IS NOT NULL GROUP BY ALL),
dn AS (SELECT doc_id, unnest(w) AS word, unnest(list_append(w[2:], NULL)) AS s FROM d WHERE doc_id IN (SELECT doc_id FROM run)), nb AS (SELECT query_id, doc_id, word, s FROM dn JOIN run USING (doc_id)),""")
def x4_sdm_parts(t):
    of = weighed(t)
    return rounded(X.sdm_parts(of.idx, of.terms, query_tokens(t), of.run), "independent", "ordered")


@query("SELECT query_id, doc_id, score AS retrieval FROM run", RUN)
def x10_retrieval_score(t):
    return X.passed_scores(run(t))


@query("""SELECT query_id, doc_id, round(list_dot_product(a.v, b.v), 6) AS dense FROM kr JOIN e a ON a.id = query_id JOIN e b ON b.id = doc_id""", KNN)
def x8_dense_dot(t):
    return rounded(X.dense_dot(knn_run(t), vectors(t), vectors(t)), "dense")


@query("""SELECT query_id, doc_id, score AS retrieval, round(s / idf_sum, 6) AS bm25_norm, round(hit / greatest(known, 1.0), 6) AS overlap FROM run JOIN bm USING (query_id, doc_id) JOIN qi USING (query_id)
 JOIN (SELECT query_id, doc_id, sum(qtf) AS hit FROM m GROUP BY ALL) USING (query_id, doc_id)""", RUN + WT)
def x12_composite(t):
    of = weighed(t)
    return rounded(X.composite(X.passed_scores(of.run), X.bm25(of).drop("bm25"), X.overlap(of)), "bm25_norm", "overlap")


@query("""SELECT query_id, word, round(0.5 * coalesce(q, 0) + 0.5 * coalesce(p, 0), 6) AS w FROM (SELECT query_id, word, qtf / sum(qtf) OVER (PARTITION BY query_id) AS q FROM qt)
FULL JOIN (SELECT query_id, word, p / sum(p) OVER (PARTITION BY query_id) AS p FROM (SELECT query_id, word, sum(tf * score / doc_len) AS p, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(tf * score / doc_len), 9) DESC, word) AS r
 FROM run JOIN post USING (doc_id) WHERE (query_id, rank) IN (SELECT query_id, max(rank) FROM run WHERE rank <= 5 GROUP BY ALL) GROUP BY query_id, word QUALIFY r <= 10)) USING (query_id, word)""", RUN)
def x5_rm3_terms(t):
    of = weighed(t)
    return rounded(X.rm3(of.idx, of.terms, of.run), "w")


@query("SELECT query_id, doc_id, round(s, 6) AS dot FROM bm", RUN)
def f9_bm25_inner_product(t):
    q, d = X.bm25_vectors(index(t), terms(t))
    x = q.withColumnRenamed("id", "query_id").withColumnRenamed("val", "_q").join(d.withColumnRenamed("id", "doc_id"), "dim")
    return rounded(x.groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("val")).alias("dot")), "dot")


@query("""SELECT a.id AS a_id, b.id AS b_id, round(list_distance(a.v, b.v), 6) AS euclid, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_dot_product(a.v, b.v), 6) AS dot
FROM e a JOIN e b ON b.id = a.id + 1""", EMB)
def f11_dense_distances(t):
    a, b = vectors(t).select(F.col("id").alias("a_id"), F.col("v").alias("av"), (F.col("id") + 1).alias("b_id")), vectors(t).select(F.col("id").alias("b_id"), F.col("v").alias("bv"))
    return rounded(a.join(b, "b_id").select("a_id", "b_id", V.euclidean("av", "bv").alias("euclid"), V.normalized_dot("av", "bv").alias("cosine"), V.dot("av", "bv").alias("dot")), "euclid", "cosine", "dot")


SPARSE = "sp AS (SELECT l_orderkey AS id, l_suppkey AS dim, sum(l_quantity) AS val FROM lineitem GROUP BY ALL),"


def sparse(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("dim")).agg(F.sum("l_quantity").alias("val"))


@query("SELECT a.id AS a_id, b.id AS b_id, round(sum(a.val * b.val), 6) AS dot FROM sp a JOIN sp b USING (dim) GROUP BY ALL", SPARSE)
def f12_sparse_dot(t):
    return rounded(V.short_pairs(sparse(t), sparse(t)).select("a_id", "b_id", "dot"), "dot")


@query("""SELECT a_id, b_id, round(sum(p * q) / (any_value(na) * any_value(nb)), 6) AS cosine FROM (SELECT a.id AS a_id, b.id AS b_id, a.val AS p, b.val AS q FROM sp a JOIN sp b USING (dim))
 JOIN (SELECT id AS a_id, sqrt(sum(val * val)) AS na FROM sp GROUP BY ALL) USING (a_id) JOIN (SELECT id AS b_id, sqrt(sum(val * val)) AS nb FROM sp GROUP BY ALL) USING (b_id) GROUP BY a_id, b_id""", SPARSE)
def f12_sparse_cosine(t):
    s = sparse(t).filter("id is not null")
    x = V.short_pairs(s, s)
    return rounded(x.select("a_id", "b_id", (F.col("dot") / F.greatest(F.col("a_norm") * F.col("b_norm"), F.lit(1e-10))).alias("cosine")), "cosine")


@query("""SELECT pair, a_id, b_id, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS jsd FROM (
 SELECT pair, max(a_id) OVER (PARTITION BY pair) AS a_id, max(b_id) OVER (PARTITION BY pair) AS b_id, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM
 (SELECT id // 2 AS pair, id AS a_id, dim, val / sum(val) OVER (PARTITION BY id) AS p FROM sp WHERE id % 2 = 0) FULL JOIN (SELECT id // 2 AS pair, id AS b_id, dim, val / sum(val) OVER (PARTITION BY id) AS q FROM sp WHERE id % 2 = 1) USING (pair, dim)) GROUP BY ALL""", SPARSE)
def f17_js_divergence(t):
    s = sparse(t)
    total = s.groupBy("id").agg(F.sum("val").alias("_all"))
    p = s.join(total, "id").select(F.floor(F.col("id") / 2).alias("pair"), "id", "dim", (F.col("val") / F.col("_all")).alias("val"))
    return rounded(V.js_divergence(p.filter("id % 2 = 0"), p.filter("id % 2 = 1")), "jsd")


@query("""SELECT id, [round(x / n, 6) for x in v] AS v FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM e)""", EMB)
def v2_l2_normalized(t):
    return vectors(t).select("id", F.transform(V.unit("v"), lambda x: V.rounded(x)).alias("v"))


@query("""SELECT id, dim, round(sum(val), 6) AS val FROM (SELECT id, 2 * dim AS dim, 0.3::DOUBLE * val AS val FROM sp UNION ALL
 SELECT o_orderkey, 2 * o_custkey + 1, 0.7::DOUBLE * o_totalprice FROM orders) GROUP BY ALL""", SPARSE)
def v4_interleaved(t):
    second = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dim"), F.col("o_totalprice").alias("val"))
    return rounded(V.interleaved([sparse(t), second], [0.3, 0.7]).groupBy("id", "dim").agg(F.sum("val").alias("val")), "val")


@query("""SELECT query_id, doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE, 6) AS jaccard FROM run JOIN (SELECT doc_id, list_distinct(w) AS w FROM d) b USING (doc_id) JOIN (SELECT query_id, list_distinct(w) AS w FROM q) a USING (query_id)""", RUN)
def f20_jaccard(t):
    a = t.benchmark.select(F.col("item_id").alias("query_id"), T.tokens("text").alias("a"))
    x = run(t).join(a, "query_id").join(index(t).docs.select("doc_id", "w"), "doc_id")
    both, any_ = F.size(F.array_intersect("a", "w")), F.size(F.array_union("a", "w"))
    return rounded(x.select("query_id", "doc_id", F.when(any_ > 0, both / any_).otherwise(0.0).alias("jaccard")), "jaccard")


WORD_VECTORS = "we AS (SELECT p_name AS word, [p_size::DOUBLE, p_retailprice, len(p_type)::DOUBLE] AS v FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1),"


@query("""SELECT l_orderkey AS id, [round(sum(l_linenumber * p_size) / count(DISTINCT l_partkey), 6), round(sum(l_linenumber * p_retailprice) / count(DISTINCT l_partkey), 6)] AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def f22_average_embedding(t):
    tokens = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("word")).agg(F.sum("l_linenumber").alias("n"))
    vecs = t.part.select(F.col("p_partkey").alias("word"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("v"))
    return X.average_embeddings(tokens, vecs).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


# --- metrics ----------------------------------------------------------------------------

EVAL = f"""
jr AS (SELECT r.query_id, r.doc_id, coalesce(g.grade, 0)::DOUBLE AS grade, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.doc_id DESC) AS i FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM lr) r LEFT JOIN lg g USING (query_id, doc_id) WHERE r.query_id IN (SELECT query_id FROM lg)),
jj AS (SELECT *, (grade > 1e-5)::INT::DOUBLE AS rel, sum((grade > 1e-5)::INT) OVER (PARTITION BY query_id ORDER BY i) AS hits, (pow(2, grade) - 1) / 16 AS stop FROM jr),
je AS (SELECT *, coalesce(product(1 - stop) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS go FROM jj),
tot AS (SELECT query_id, sum((grade > 1e-5)::INT)::DOUBLE AS n_rel, sum(CASE WHEN i <= 3 THEN grade / log2(i + 1) ELSE 0 END) AS idcg, sum(CASE WHEN i <= 3 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS idcg_exp FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM lg) GROUP BY ALL),
pq AS (SELECT query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, CASE WHEN n_rel > 0 THEN ap / n_rel ELSE 0 END AS map, coalesce(1.0::DOUBLE / first, 0) AS mrr, CASE WHEN n_rel > 0 THEN hit / n_rel ELSE 0 END AS recall, hit / 3 AS precision, rhit / greatest(n_rel, 1) AS rprec,
  dcg_exp, CASE WHEN idcg_exp > 0 THEN dcg_exp / idcg_exp ELSE 0 END AS ndcg_exp, err, hit / shown AS precision_shown, best FROM (
 SELECT query_id, any_value(n_rel) AS n_rel, any_value(idcg) AS idcg, any_value(idcg_exp) AS idcg_exp, sum(grade * rel / log2(i + 1)) AS dcg, sum((pow(2, grade) - 1) / log2(i + 1)) AS dcg_exp, sum(rel * hits / i) AS ap, min(CASE WHEN rel > 0 THEN i END) AS first,
  sum(rel) AS hit, sum(CASE WHEN i <= n_rel THEN rel ELSE 0 END) AS rhit, sum(go * stop / i) AS err, max(grade) AS best, least(count(*), 3)::DOUBLE AS shown FROM je JOIN tot USING (query_id) GROUP BY query_id)),
"""
METRICS = ("ndcg", "map", "mrr", "recall", "precision", "rprec", "dcg_exp", "ndcg_exp", "err", "precision_shown", "best")


@query(f"SELECT query_id, {r(*METRICS)} FROM pq", L + LG + EVAL)
def e8_per_query(t):
    return rounded(E.per_query(line_run(t), line_grades(t), 3), *METRICS)


@query("SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM pq", L + LG + EVAL)
def a6_mean_metrics(t):
    return rounded(E.means(line_run(t), line_grades(t), 3), *METRICS)


@query("SELECT query_id, doc_id, grade FROM qrels", QRELS)
def q15_answer_qrels(t):
    return qrels(t)


@query("SELECT r.query_id, r.doc_id, coalesce(g.grade, 0.0)::DOUBLE AS grade, rank FROM run r LEFT JOIN qrels g USING (query_id, doc_id) WHERE r.query_id IN (SELECT query_id FROM qrels)", RUN + QRELS)
def j6_judged_run(t):
    return E.judged(run(t), qrels(t)).select("query_id", "doc_id", "grade", F.col("i").alias("rank"))


@query(None)
def e13_report(t):
    x = E.report(stored(t, 100), cut(qrels(t), "qrels"))
    return rounded(x, *x.columns[1:])


@query(None)
def r17_permutation_test(t):
    of, q = weighed(t), cut(qrels(t), "qrels")
    a, b = E.per_query(of.run, q, K), E.per_query(C.top(C.summed(of._all(), k1=0.4, b=0.3), K), q, K)
    return E.permutation_test(a, b, "map", 1000)


@query("""SELECT bucket, count(*) AS n FROM (SELECT list_sum([(g > x)::INT for x in [-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0]])::INT AS bucket FROM (SELECT CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0 ELSE 1 END ELSE (b - a) / a END AS g
 FROM (SELECT query_id, round(ndcg, 6) AS a, round(mrr, 6) AS b FROM pq))) GROUP BY ALL""", L + LG + EVAL)
def r16_compared_runs(t):
    x = rounded(E.per_query(line_run(t), line_grades(t), 3), "ndcg", "mrr")
    return E.compared(x.select("query_id", F.col("ndcg").alias("m")), x.select("query_id", F.col("mrr").alias("m")), "m")
