import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklode.functions import sequences as Q
from ranklode.functions import text as T
from ranklode.functions import vectors as V
from ranklode.operators import candidates as C
from ranklode.operators import evaluate as E
from ranklode.operators import features as X
from ranklode.operators import index as I
from ranklode.operators import ltr as R
from ranklode.operators import passes as P
from ranklode.operators import sampling as S
from ranklode.operators import scoring as N
from ranklode.operators import tranmodel as M
from ranklode.plans import QUERIES, SQL


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_soft_alignment_of_one_hot_words_is_the_common_subsequence():
    a, b = "abcde", "bde"
    d = np.array([[0.0 if x == y else 2.0 for y in b] for x in a])
    assert Q.alignments(d, 0.0) == (3.0, 3.0, 3.0)
    assert Q.alignments(np.zeros((0, 0)), 0.0) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        Q.alignments(d, -1)


def test_common_subsequence(spark):
    d = spark.createDataFrame([(list("abcde"), list("bde")), ([], ["a"]), (list("xaybzc"), list("abc"))], "a array<string>, b array<string>")
    assert [r.n for r in d.select(Q.common_subsequence("a", "b").alias("n")).collect()] == [3, 0, 3]


def test_emd_bounds(spark):
    m = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((10.0, 1.0), (1.0, 10.0), (10.0, 10.0))))
    ones = lambda n: F.array(*[F.lit(1.0)] * n)
    got = value(spark, V.emd_bounds(m, ones(3), ones(2)))
    assert (got.left, got.right) == (12.0, 2.0)
    far = F.array(F.array(F.lit(float("inf"))))
    assert tuple(value(spark, V.emd_bounds(far, ones(1), ones(1)))) == (0.0, 0.0)


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, v)) for v in ((3.0, 4.0), (4.0, 3.0), (0.0, 0.0)))
    assert value(spark, V.dot(a, b)) == 24 and value(spark, V.euclidean(a, b)) == pytest.approx(math.sqrt(2)) and value(spark, V.normalized_dot(a, a)) == pytest.approx(1)
    assert value(spark, V.l2_normalized(a)) == [0.6, 0.8] and value(spark, V.l2_normalized(z)) == [0.0, 0.0] and value(spark, V.cosine(a, z)) == 0.0
    assert value(spark, V.mean_pool(F.array(a, b, z), F.array(*map(F.lit, (1, 1, 0))))) == [3.5, 3.5]
    assert value(spark, N.attention(F.array(a, b), z)) == pytest.approx([3.5, 3.5])
    assert value(spark, N.late_interaction(F.array(a), F.array(a, b))) == 25.0


def test_unit_vectors_whatever_the_norm(spark, tmp_path):
    """Zeros and vectors of tiny components give what the SQL of v2_l2_normalized gives."""
    rows = [(1, [0.0, -0.0]), (2, [1e-12, -2e-12]), (3, [1e-30, -1e-30]), (4, [3.0, 4.0]), (5, []), (6, None), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [-1e-9, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["v2_l2_normalized"](spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, repr(r.v)) for r in got] == [(i, repr(v)) for i, v in sorted(con.sql(SQL["v2_l2_normalized"]).fetchall())]
    both = F.array(F.lit(1e-200), F.lit(-1e-200))
    assert value(spark, V.unit(both)) == [float("inf"), float("-inf")]


def test_interleaved_dot_is_the_weighted_sum(spark):
    r = np.random.default_rng(1)
    make = lambda: spark.createDataFrame([(i, d, float(r.random())) for i in range(4) for d in range(6) if r.random() < 0.6], "id int, dim int, val double")
    a, b = make(), make()
    x = V.interleaved([a, b], [0.3, 0.7])
    ones = V.interleaved([a, b], [1.0, 1.0])
    key = lambda df: {(q.a_id, q.b_id): q.dot for q in df.collect()}
    got, da, db = key(V.sparse_dot(x, ones)), key(V.sparse_dot(a, a)), key(V.sparse_dot(b, b))
    assert got == pytest.approx({k: 0.3 * da.get(k, 0) + 0.7 * db.get(k, 0) for k in da.keys() | db.keys()})


def test_bm25_is_its_inner_product(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b b d"), (3, ""), (4, None)], "doc_id int, text string")
    idx, q = I.build(docs), I.query_terms(spark.createDataFrame([(7, "a b x b")], "item_id int, text string"))
    one = {(r.query_id, r.doc_id): r.score for r in C.bm25(idx, q).collect()}
    u, v = X.bm25_vectors(idx, q)
    two = {(r.a, r.b): r.s for r in u.withColumnRenamed("id", "a").join(v.select(F.col("id").alias("b"), "dim", F.col("val").alias("w")), "dim").groupBy("a", "b").agg(F.sum(F.col("val") * F.col("w")).alias("s")).collect()}
    assert one == pytest.approx(two) and set(one) == {(7, 1), (7, 2)}


def test_case_and_words(spark):
    assert value(spark, T.handle_case(F.lit(None).cast("string"))) == "" and value(spark, T.handle_case(F.lit("AbC"))) == "abc"
    assert value(spark, T.tokens(F.lit("  A  b\tc\n"))) == ["a", "b", "c"] and value(spark, T.tokens(F.lit(""))) == []
    assert value(spark, Q.without_marks(F.lit("café ñ"))) == "cafe n"
    assert value(spark, T.pretokenize_url(F.lit("https://www.a-b.com/c%20d?e=f"))) == "a b com c d e f"


@pytest.mark.parametrize("name,want", [("mrr", E.NO_CUT), ("mrr@20", 20), ("ndcg@130", 130), ("recip_rank@5", 5)])
def test_metric_names(name, want):
    assert E.parsed(name)[1] == want


@pytest.mark.parametrize("name", ["mrr@0", "ndcg@x", "nothing", "precision"])
def test_bad_metric_names(name):
    with pytest.raises(ValueError):
        E.parsed(name)


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0), ("unjudged", "a", 1.0)], "query_id string, doc_id string, score double")
    rel = spark.createDataFrame([("q", "b", 2.0), ("q", "c", 0.0), ("q", "d", 1.0), ("missing", "a", 1.0)], "query_id string, doc_id string, grade double")
    assert E.evaluate(run, rel, "mrr") == 0.5 and E.evaluate(run, rel, "map") == 0.25 and E.evaluate(run, rel, "recall") == 0.5 and E.evaluate(run, rel, "P@2") == 0.5
    assert E.evaluate(run, rel, "ndcg") == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)))


def test_tail_shift_keeps_order(spark):
    run = spark.createDataFrame([("q", f"d{k}", 10.0 - k, k + 1) for k in range(6)], "query_id string, doc_id string, score double, rank int")
    new = spark.createDataFrame([("q", "d0", 0.2), ("q", "d1", 0.9)], "query_id string, doc_id string, score double")
    got = {r.doc_id: r.score for r in C.tail_shifted(run, new, 2).collect()}
    assert got["d1"] == 0.9 and got["d0"] == 0.2 and all(got[f"d{k}"] < got[f"d{k - 1}"] for k in range(3, 6)) and got["d2"] < 0.2


@pytest.mark.parametrize("n", [1, 5, 20])
def test_chunk_sampler(spark, n):
    pairs = spark.createDataFrame([(q, d, d == 0) for q in range(3) for d in range(8)] + [(9, 0, True)], "query_id int, doc_id int, positive boolean")
    got = S.chunk_sampler(pairs, n).collect()
    assert {r.query_id for r in got} == {0, 1, 2}
    for q in range(3):
        mine = [r for r in got if r.query_id == q]
        assert sorted(r.slot for r in mine) == list(range(n + 1)) and [r.positive for r in mine if r.slot == 0] == [True] and sum(not r.positive for r in mine) == n


def test_samples_and_splits(spark):
    d = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert S.sample(d, "doc_id", 37).count() == 37
    with pytest.raises(ValueError):
        S.split_by_sizes(d, "doc_id", {"a": 10, "b": 20})
    parts = {r.part: r.n for r in S.split_by_sizes(d, "doc_id", {"a": 10, "b": None, "c": 20}).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"a": 10, "b": 970, "c": 20}
    w = spark.createDataFrame([(k, float(k)) for k in range(5)], "id int, w double")
    got = {r.id: r.n for r in S.weighted_with_replacement(w, "id", "w", 4000).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert 0 not in got and all(abs(got[k] - 400 * k) < 6 * math.sqrt(400 * k) for k in range(1, 5))
    with pytest.raises(ValueError):
        S.weighted_with_replacement(w.withColumn("w", F.lit(-1.0)), "id", "w", 3)


def test_translation_rescaling(spark):
    t = spark.createDataFrame([("find", "find", 0.125236), ("find", "lost", 0.5), ("odd", "lane", 0.0162683)], "src string, dst string, p double")
    got = {(r.src, r.dst): r.p for r in M.rescaled(t, 0.5).collect()}
    assert got[("find", "find")] == pytest.approx(0.562618, abs=1e-7) and got[("odd", "lane")] == pytest.approx(0.00813415, abs=1e-8) and got[("odd", "odd")] == 0.5


def test_sequential_pass_never_tests_some_places():
    q, n = ["a", "b"], 30
    hits = [i for i in range(n) if P.unordered_pairs(q, ["x"] * i + ["a"] + ["b"] * (n - i - 1), 8) or P.unordered_pairs(q, ["b"] * i + ["a"] + ["b"] * (n - i - 1), 8)]
    assert hits == [*range(7), *range(8, n - 9)]


def test_learning(spark):
    r = np.random.default_rng(3)
    rows = [(q, d, float(d == 0), [float(d == 0) + 0.1 * r.random(), 5 * float(r.random())]) for q in range(12) for d in range(5)]
    x = spark.createDataFrame(rows, "query_id int, doc_id int, grade double, feats array<double>")
    w, value_ = R.coordinate_ascent(x, k=5, restarts=1, iterations=2, levels=3)
    assert value_ == pytest.approx(1.0) and w[0] > w[1]
    lin = R.linear_regression(x)
    top = R.reranked(x, R.linear(lin[:2]), 1).collect()
    assert {t.doc_id for t in top} == {0}
    m = R.lambda_mart(x, trees=2)
    s = R.boosted_score(x, m).groupBy("query_id").agg(F.max_by("doc_id", "score").alias("d")).collect()
    assert {t.d for t in s} == {0}
    parts = list(R.cross_validation(x, 5))
    assert [b.select("query_id").distinct().count() for _, b in parts] == [2, 2, 2, 2, 4]


def test_streams(spark, tmp_path):
    from ranklode.streaming import documents as D

    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id int, text string").write.parquet(str(tmp_path / "d"))
    terms = spark.createDataFrame([(9, "a"), (9, "z")], "query_id int, word string")
    q = D.matched(spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "d")), terms).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.doc_id, r.query_id) for r in spark.table("hits").collect()] == [(1, 9)]
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", "t", 1.0), (1, "2024-01-01 00:00:01", "t", 1.0), (2, "2024-01-01 00:00:02", "t", 2.0)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "e"))
    q = D.first_events(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2


def test_rounding_keeps_the_sign_of_zero(spark):
    given = [-1e-8, 1e-8, -0.0, 0.0, -0.0000005, 1.2345675, -2.5, None]
    got = value(spark, F.transform(F.array(*(F.lit(x).cast("double") for x in given)), lambda x: V.rounded(x)))
    assert list(map(repr, got)) == ["-0.0", "0.0", "-0.0", "0.0", "-1e-06", "1.234568", "-2.5", "None"]


def test_greatest_of_zeros_is_the_last(spark):
    import duckdb

    for column in ([-0.0, 0.0], [0.0, -0.0], [-1.0, -0.0, 0.0, -0.0], [0.0, -0.0, 0.0], [-0.0, -1.0, 0.0], [0.0, -1.0, -0.0], [2.0, -0.0, 1.0]):
        d = spark.createDataFrame([([[x] for x in column],)], "vs array<array<double>>")
        want = duckdb.execute("select list_max(?::double[])", [column]).fetchone()[0]
        assert repr(d.select(N.max_vectors("vs").alias("x")).first().x) == repr([want])


def test_attention_works_out_its_products_once(spark):
    """Products and their sum are worked out once a row, not for each component."""
    x = N.attention("vs", F.col("vs")[0])
    rows = spark.sql("select array(array(1D, 2D), array(0.5D, -1D), array(0D, 3D)) vs").select(x.alias("v"))
    w = [math.exp(p - 6.0) for p in (5.0, -1.5, 6.0)]
    assert rows.first().v == pytest.approx([(w[0] + 0.5 * w[1]) / sum(w), (2 * w[0] - w[1] + 3 * w[2]) / sum(w)], abs=1e-12)
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") == 1


def test_short_pairs_shuffle_vectors_only(spark):
    """As the plain products, with vectors that share several dimensions, repeated and null values."""
    rows = [(k, (k * k + j * (k % 5 + 1)) % 9, float(k % 4 + j)) for k in range(30) for j in range(k % 6)] + [(3, 4, 2.0), (7, 1, None), (40, 8, None), (41, -1, 2.0)]
    x = spark.createDataFrame(rows, "id long, dim int, val double")
    few = x.filter("id % 3 = 0")
    found = V.short_pairs(few, x)
    norms = {r.id: r.norm for r in V.sparse_norms(x).collect()}
    got = {(r.a_id, r.b_id): r.dot for r in found.collect()}
    assert got == {(r.a_id, r.b_id): r.dot for r in V.sparse_dot(few, x).collect()} and found.count() == len(got)
    assert all(r.a_norm == norms[r.a_id] and r.b_norm == norms[r.b_id] for r in found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
