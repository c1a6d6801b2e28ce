"""Queries of learning to rank, scorers and sequence functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.functions import sequences as Q
from ranklode.functions import text as T
from ranklode.functions import vectors as V
from ranklode.operators import ltr as R
from ranklode.operators import scoring as S
from ranklode.operators import trees as B
from ranklode.plans.registry import Tables, query
from ranklode.plans.retrieval import EMB, KNN, RUN, knn_run, rounded, run, vectors

FEATS = "fe AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(CASE WHEN l_quantity > 40 THEN 2.0 WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END)::DOUBLE AS grade, max(l_extendedprice) AS f1, max(l_discount) AS f2, max(l_tax) AS f3 FROM lineitem GROUP BY ALL),"


def feature_rows(t: Tables) -> DataFrame:
    g = F.when(F.col("l_quantity") > 40, 2.0).when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.max(g).alias("grade"), F.max("l_extendedprice").alias("f1"), F.max("l_discount").alias("f2"), F.max("l_tax").alias("f3"))
    return x.select("query_id", "doc_id", "grade", F.array("f1", "f2", "f3").alias("feats"))


@query("""SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INT AS rank FROM
 (SELECT query_id, doc_id, round(0.001::DOUBLE * f1 + 2.0::DOUBLE * f2 - 1.0::DOUBLE * f3, 6) AS score FROM fe) QUALIFY rank <= 3""", FEATS)
def r1_linear_rerank(t):
    return R.reranked(feature_rows(t), R.linear([0.001, 2.0, -1.0]), 3)


TREES = [{"weight": 0.5, "tree": {"feature": 1, "threshold": 30000.0, "left": {"value": 1.0}, "right": {"feature": 2, "threshold": 0.05, "left": {"value": 2.0}, "right": {"value": 3.0}}}}, {"weight": 0.25, "tree": {"feature": 3, "threshold": 0.04, "left": {"value": -1.0}, "right": {"value": 1.0}}}]


@query("SELECT query_id, doc_id, 0.5::DOUBLE * CASE WHEN f1 <= 30000 THEN 1 WHEN f2 <= 0.05::DOUBLE THEN 2 ELSE 3 END + 0.25::DOUBLE * CASE WHEN f3 <= 0.04::DOUBLE THEN -1 ELSE 1 END AS score FROM fe", FEATS)
def r2_tree_model(t):
    return feature_rows(t).select("query_id", "doc_id", R.tree_score(TREES).alias("score"))


@query("""SELECT query_id, doc_id, [round(f1 / sum(abs(f1)) OVER w, 6), round(coalesce(f2 / nullif(sum(abs(f2)) OVER w, 0), f2), 6), round(coalesce(f3 / nullif(sum(abs(f3)) OVER w, 0), f3), 6)] AS feats FROM fe WINDOW w AS (PARTITION BY query_id)""", FEATS)
def w7_normalized_features(t):
    return R.normalized(feature_rows(t), "sum").select("query_id", "doc_id", F.transform("feats", lambda x: F.round(x, 6)).alias("feats"))


@query("SELECT round(regr_slope(grade, f1) * 1000, 6) AS slope, round(regr_intercept(grade, f1), 6) AS intercept FROM fe", FEATS)
def r11_linear_regression(t):
    w = R.linear_regression(feature_rows(t).withColumn("feats", F.slice("feats", 1, 1)))
    return t.spark.range(1).select(F.round(F.lit(w[0] * 1000), 6).alias("slope"), F.round(F.lit(w[1]), 6).alias("intercept"))


@query("SELECT query_id, least((row_number() OVER (ORDER BY query_id) - 1) // greatest(count(*) OVER () // 5, 1), 4)::INT AS fold FROM (SELECT DISTINCT query_id FROM fe)", FEATS)
def r14_folds(t):
    return R.folds(feature_rows(t).select("query_id").distinct(), 5)


@query(None)
def r3_coordinate_ascent(t):
    x = R.normalized(feature_rows(t), "linear")
    w, value = R.coordinate_ascent(x, k=5, restarts=1, iterations=1, levels=4)
    return t.spark.createDataFrame([(k + 1, float(v), float(value)) for k, v in enumerate(w)], "feature int, weight double, ndcg double")


@query(None)
def r5_mart(t):
    x = feature_rows(t)
    return x.select("query_id", "doc_id", R.tree_score(B.mart(x, trees=2, leaves=4)).alias("score"))


@query(None)
def r6_random_forest(t):
    x = feature_rows(t)
    bags = B.random_forest(x, bags=2, leaves=4)
    return x.select("query_id", "doc_id", (sum(map(R.tree_score, bags), F.lit(0.0)) / len(bags)).alias("score"))


@query(None)
def r4_lambda_mart(t):
    x = feature_rows(t)
    return x.select("query_id", "doc_id", R.tree_score(B.lambda_mart(x, trees=2, leaves=4)).alias("score"))


@query("""SELECT query_id, doc_id, round(sum(CASE WHEN g > h THEN rho * dl ELSE -rho * dl END), 6) AS lam FROM (SELECT query_id, doc_id, g, h, abs((pow(2, g) - pow(2, h)) * (CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END - CASE WHEN i2 <= 10 THEN 1 / log2(i2 + 1) ELSE 0 END)) / greatest(z, 1e-12::DOUBLE) AS dl,
 1 / (1 + exp(CASE WHEN g > h THEN s - s2 ELSE s2 - s END)) AS rho FROM (SELECT a.query_id, a.doc_id, a.grade AS g, b.grade AS h, a.s, b.s AS s2, a.i, b.i AS i2, a.z FROM rk a JOIN rk b ON a.query_id = b.query_id AND a.grade <> b.grade)) GROUP BY ALL""",
FEATS + "rj AS (SELECT query_id, doc_id, grade, f2 AS s, row_number() OVER (PARTITION BY query_id ORDER BY f2 DESC, doc_id DESC) AS i, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id DESC) AS j FROM fe), rk AS (SELECT *, sum(CASE WHEN j <= 10 THEN (pow(2, grade) - 1) / log2(j + 1) ELSE 0 END) OVER (PARTITION BY query_id) AS z FROM rj),")
def e12_swap_gradients(t):
    return rounded(R.lambdas(feature_rows(t).withColumn("score", F.col("feats")[1])).select("query_id", "doc_id", "lam"), "lam")


@query("""SELECT query_id, doc_id, round(score + 0.1::DOUBLE * retrieval, 8) AS score FROM (SELECT query_id, doc_id, score AS retrieval, len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / greatest(1, len(list_distinct(a.w)))::DOUBLE AS score FROM run JOIN q a USING (query_id) JOIN d b USING (doc_id))""", RUN)
def x11_external_scorer(t):
    x = run(t).join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id").join(t.documents.select("doc_id", F.col("text").alias("d")), "doc_id")
    # a tenth of six decimals: no place of eight is a tie
    return x.select("query_id", "doc_id", F.round(S.fused(S.scored("overlap", "q", "d"), "score", 0.1), 8).alias("score"))


GROUPS = EMB + "vg AS (SELECT id // 5 AS g, list(v ORDER BY id) AS vs FROM e GROUP BY ALL),"


def groups(t: Tables) -> DataFrame:
    return vectors(t).groupBy(F.floor(F.col("id") / 5).alias("g")).agg(F.sort_array(F.collect_list(F.struct("id", "v")))["v"].alias("vs"))


NEXT = "nx AS (SELECT a.g, a.vs, b.vs AS n FROM vg a JOIN vg b ON b.g = a.g + 1),"


def with_next(t: Tables) -> DataFrame:
    """Each group's vectors with the next group's."""
    return groups(t).join(groups(t).select((F.col("g") - 1).alias("g"), F.col("vs").alias("n")), "g")


@query("SELECT g, round(list_sum([list_max([list_dot_product(q, x) for x in n]) for q in vs]), 6) AS score FROM nx", GROUPS + NEXT)
def v6_late_interaction(t):
    return rounded(with_next(t).select("g", S.late_interaction("vs", "n").alias("score")), "score")


@query("SELECT g, [round(list_avg([x[k] for x in vs]), 6) for k in range(1, 65)] AS mean, [round(list_max([x[k] for x in vs]), 6) for k in range(1, 65)] AS top FROM vg", GROUPS)
def t25_pooled_vectors(t):
    r6 = lambda c: F.transform(c, lambda x: V.rounded(x))
    return groups(t).select("g", r6(S.mean_vectors("vs")).alias("mean"), r6(S.max_vectors("vs")).alias("top"))


@query("SELECT query_id, round(max(score), 6) AS top, round(sum(score), 6) AS total, round(avg(score), 6) AS mean FROM kr GROUP BY query_id", KNN)
def s218_passage_aggregation(t):
    x = knn_run(t).groupBy("query_id").agg(F.collect_list("score").alias("s"))
    return rounded(x.select("query_id", S.max_passage("s").alias("top"), S.sum_passage("s").alias("total"), S.mean_passage("s").alias("mean")), "top", "total", "mean")


@query(None)
def f13_common_subsequence(t):
    w = t.documents.select("doc_id", T.tokens("text").alias("w"))
    nxt = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(nxt, "doc_id").select("doc_id", Q.common_subsequence("w", "v").alias("lcs"))


@query(None)
def f14_soft_alignment(t):
    x = groups(t)
    y = x.select((F.col("g") - 1).alias("g"), F.col("vs").alias("ws"))
    return Q.soft_alignments(x.join(y, "g").select("g", V.distance_matrix("vs", "ws").alias("m")), "m", 0.8)


@query("""SELECT g, round(list_sum([list_min([1 - list_cosine_similarity(x, y) for y in n]) for x in vs]), 6) AS "left", round(list_sum([list_min([1 - list_cosine_similarity(x, y) for x in vs]) for y in n]), 6) AS "right" FROM nx""", GROUPS + NEXT)
def f16_emd_bounds(t):
    ones = lambda c: F.transform(F.col(c), lambda _: F.lit(1.0))
    x = with_next(t).select("g", V.emd_bounds(V.distance_matrix("vs", "n"), ones("vs"), ones("n")).alias("b"))
    return rounded(x.select("g", "b.left", "b.right"), "left", "right")


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def t4_without_marks(t):
    return t.documents.select("doc_id", Q.without_marks("text").alias("text"))
