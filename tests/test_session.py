"""The shared folder: its name, and what is left in it."""

import os
import re
from types import SimpleNamespace
from urllib.parse import urlsplit

import pytest

from ranklode import session
from ranklode.operators import sampling
from ranklode.plans import QUERIES


def there(path):
    return os.path.exists(urlsplit(path).path)


def test_folders_are_removed(spark):
    since = session.made()
    a, b, c = (session.cut(spark.range(n), "t") for n in (1, 2, 3))
    assert [x._folder.startswith("file:/") for x in (a, b, c)] == [True] * 3 and all(there(x._folder) for x in (a, b, c))
    session.forget(a, spark.range(1))
    assert not there(a._folder) and b.count() == 2
    session.clean(spark, since, keep=c)
    assert not there(b._folder) and there(c._folder) and c.count() == 3 and session.made() == since + 1
    session.clean(spark, since)
    assert not there(c._folder) and session.made() == since


def test_a_path_without_scheme_is_qualified(spark, tmp_path):
    sc = spark.sparkContext
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: str(tmp_path)))
    assert session.shared_dir(fake, "x").startswith(f"file://{tmp_path}/x-")
    session._made.pop()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_folder(spark, master):
    sc = spark.sparkContext
    none = SimpleNamespace(isDefined=lambda: False)
    fake = SimpleNamespace(master=master, _jvm=sc._jvm, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none), hadoopConfiguration=sc._jsc.hadoopConfiguration))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=fake, conf=SimpleNamespace(get=lambda k, d=None: None)), "x")
    fake.master = "local[4]"
    assert session.shared_dir(SimpleNamespace(sparkContext=fake, conf=SimpleNamespace(get=lambda k, d=None: None)), "x").startswith("file:/")
    session._made.pop()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_cluster_takes_a_mounted_folder(spark, tmp_path, master, scheme):
    """The setting says that the folder is shared, with a scheme or without."""
    sc = spark.sparkContext
    fake = SimpleNamespace(master=master, _jvm=sc._jvm, _jsc=sc._jsc)
    conf = SimpleNamespace(get=lambda k, d=None: f"{scheme}{tmp_path}")
    assert session.shared_dir(SimpleNamespace(sparkContext=fake, conf=conf), "x").startswith(f"file://{tmp_path}/x-")
    session._made.pop()


@pytest.mark.parametrize("name", ["t18_resolved_links", "t16_html_text", "t11_porter_stems"])
def test_pages_come_in_small_batches(spark, name):
    """Batches of Spark's 10,000 rows hold as many whole pages or texts, and what is made of them."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= session.BATCH_ROWS
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("name", ["k4_postings", "s29_rebuilt_text"])
def test_texts_are_dealt_whole(spark, name):
    """What is grouped by document is shuffled as texts, not word by word."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "ENSURE_REQUIREMENTS" not in plan


def test_parts_grow_with_the_input(spark, monkeypatch):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    few = session.parts(t)
    monkeypatch.setattr(session, "PART_BYTES", 1000)
    assert session.parts(t) > few and session.dealt(t, "l_orderkey").rdd.getNumPartitions() == session.parts(t.filter("l_orderkey > 0"))


def test_words_are_counted_once(spark):
    """The counts are written; their total doesn't split the texts again."""
    plan = QUERIES["m7_collection_probabilities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "counts-" in plan


@pytest.mark.parametrize("name", ["f22_average_embedding", "q16_run_faults", "e8_per_query", "a6_mean_metrics", "u1_hybrid_run", "q12_chunk_sampler"])
def test_lines_are_dealt_by_size(spark, monkeypatch, name):
    """Twice as many parts for twice the input, whatever the number of shuffle partitions."""
    monkeypatch.setattr(session, "PART_BYTES", 1000)
    size = os.path.getsize("/root/testdata/sf0.001/lineitem.parquet")
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    found = [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert found and min(found) >= size // 1000


def test_faults_of_odd_runs(spark):
    run = spark.createDataFrame([(1, 1, 1, 5.0), (1, None, 2, 4.0), (1, None, 3, 3.0), (2, 1, 1, 1.0), (2, 2, 2, 2.0), (None, 9, 1, 1.0)], "query_id int, doc_id int, rank int, score double")
    got = {tuple(r) for r in sampling.run_faults(run, spark.createDataFrame([(1,), (2,), (2,)], "doc_id int"), 2).collect()}
    assert got == {(1, "repeated document"), (1, "unknown document"), (2, "rising score"), (None, "unknown document"), (None, "too few results")}


SHARED = ("a11_quantiles a14_feature_statistics a5_parent_sum c1_bm25_topk c1_cleaned_queries c1_word_champions c3_cells c3_knn c3_knn_of_all c4_stored_run c6_found "
          "c7_knn_cosine e13_report f10_cosine_inner_product f20_jaccard f21_bm25_of_texts f2_query_normaliser f3_soft_bm25 f9_bm25_inner_product j11_judged_or_sampled "
          "j13_contained_answers j14_token_overlap j4_features_of_parents op11_hard_negatives op12_vector_codes op13_best_fit_packing op2_ngram_jaccard").split()  # fmt: skip


@pytest.mark.parametrize("name", SHARED)
def test_queries_take_a_mounted_folder(spark, tmp_path, monkeypatch, name):
    """Whole queries, as on a cluster whose setting names a folder without scheme."""
    import __spark_entry__

    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *a))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    since = session.made()
    try:
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").columns
        assert all(x.startswith(f"file://{tmp_path}/") for x in session._made[since:])
    finally:
        session.clean(spark, since)
