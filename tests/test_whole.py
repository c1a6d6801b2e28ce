"""Queries do their whole job: what used to be left out by the query and by its SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ranklode import session
from ranklode.functions import vectors
from ranklode.operators import candidates, tranmodel
from ranklode.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    """Lines of three orders, none of which has a number that fifty divides."""
    sf = str(tmp_path_factory.mktemp("sparse"))
    spark.createDataFrame([(1, 7, 2.0), (1, 8, 1.0), (2, 7, 3.0), (3, 8, 4.0), (3, 8, 1.0)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{sf}/lineitem.parquet")
    return sf


def by_sql(sf, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{sf}/lineitem.parquet/*.parquet'")
    return {tuple(r) for r in con.sql(SQL[name]).fetchall()}


def test_sparse_dot_of_all_vectors(spark, sparse):
    got = {tuple(r) for r in QUERIES["f12_sparse_dot"](spark, sparse).collect()}
    assert got == by_sql(sparse, "f12_sparse_dot") == {(1, 1, 5.0), (1, 2, 6.0), (2, 1, 6.0), (2, 2, 9.0), (1, 3, 5.0), (3, 1, 5.0), (3, 3, 25.0)}


def test_sparse_cosine_of_all_vectors(spark, sparse):
    got = {tuple(r) for r in QUERIES["f12_sparse_cosine"](spark, sparse).collect()}
    assert got == by_sql(sparse, "f12_sparse_cosine") and {r[:2] for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1), (3, 3)}


def test_soft_counts_words_that_no_query_has(spark, tmp_path):
    """alphb is as near to alpha as alpha itself, by the vectors that the SQL gives words."""
    spark.createDataFrame([(1, "alpha alphb"), (2, "gamma delta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in QUERIES["f3_soft_bm25"](spark, str(tmp_path)).collect()] == [(5, 1, round(math.log(2) * 2 * 2.2 / 3.2, 6))]


@pytest.mark.parametrize("limit", [1 << 20, 50])
def test_training_writes_no_word_pairs(spark, monkeypatch, limit):
    """The table is that of plain loops, and no table written on the way has more rows than the texts have words."""
    monkeypatch.setattr(tranmodel, "PART_WORDS", limit)
    written = []
    keep = lambda df, what: written.append(df.count()) or session.cut(df, what)
    monkeypatch.setattr(tranmodel, "cut", keep)
    r = random.Random(4)
    say = lambda n: [f"w{int(r.paretovariate(0.5))}" for _ in range(n)]
    rows = [(k, say(60), say(80)) for k in range(20)]
    table = {}
    for k in range(3):
        counts, total = Counter(), Counter()
        for _, src, dst in rows:
            for d in dst:
                p = {s: table[s, d] if k else 1.0 for s in src}
                whole = sum(p[s] for s in src)
                for s in src:
                    counts[s, d] += p[s] / whole
                    total[s] += p[s] / whole
        table = {x: c / total[x[0]] for x, c in counts.items()}
    got = {(x.src, x.dst): x.p for x in tranmodel.train(spark.createDataFrame(rows, "pair long, src array<string>, dst array<string>"), 3).collect()}
    assert set(got) == set(table) and all(abs(p - got[x]) < 1e-9 for x, p in table.items())
    assert max(written, default=0) <= 20 * 80
    some = {x for x, p in table.items() if p >= 0.05}
    assert {(x.src, x.dst) for x in tranmodel.train(spark.createDataFrame(rows, "pair long, src array<string>, dst array<string>"), 3, 0.05).collect()} == some


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_settings_do_not_multiply_matches(spark):
    """Scores under all settings stand in one row: no row for each match and setting."""
    plan = physical(QUERIES["q21_bm25_settings"](spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exact_match_of_few_keys(spark):
    """Only a key's best documents meet its queries, whatever repeats and however many keys a query has."""
    docs = spark.createDataFrame([(k // 2, k % 3 if k % 7 else None) for k in range(200)], "doc_id long, nation int")
    asked = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (2, 1), (3, None), (4, 9)], "query_id long, key int")
    found = candidates.exact_match(docs, asked, "nation", 5)
    every = docs.withColumnRenamed("nation", "key").join(asked, "key").select("query_id", "doc_id", F.lit(1.0).alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, candidates.top(every, 5).collect()))
    plan = physical(found)
    assert "doc_id" in plan[plan.rindex("Join") :].split("Window", 1)[1]  # ranked below the join too


@pytest.mark.parametrize("sizes", [(1 << 19, 1 << 21), (40, 30)])
def test_sparse_products_are_made_in_blocks(spark, monkeypatch, sizes):
    """As the plain join's, with null values and ids; pairs aren't shuffled."""
    monkeypatch.setattr(vectors, "BLOCK_ENTRIES", sizes[0])
    monkeypatch.setattr(vectors, "BLOCK_PRODUCTS", sizes[1])
    r = random.Random(2)
    side = lambda n, d: spark.createDataFrame([(k or None, x, float(r.randint(0, 5)) if r.random() < 0.9 else None) for k in range(n) for x in r.sample(range(12), r.randint(1, d))], "id long, dim int, val double")
    a, b = side(30, 4), side(40, 6)
    got = vectors.sparse_products(a, b)
    assert sorted(map(str, got.collect())) == sorted(map(str, vectors.sparse_dot(a, b).collect()))
    assert physical(QUERIES["x9_sparse_embeddings"](spark, "/root/testdata/sf0.001")).count("HashAggregate") == 0
