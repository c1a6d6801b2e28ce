"""The kept index, nearest vectors and containment against plain counterparts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklode import session
from ranklode.operators import candidates, containment, impact, index, nearest, sampling, tranmodel
from ranklode.session import shared_dir


def texts(n=400, seed=1):
    """Few common words, many rare ones, copies, empty and null texts."""
    r = random.Random(seed)
    rare = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    out = [" ".join(r.choice(("the", "of", "and")) if r.random() < 0.5 else r.choice(rare[: 3 * (k + 1)]) for _ in range(r.randint(1, 60))) for k in range(n)]
    out[50:90] = [out[3]] * 40
    return [*out, "", "  \n", None, "the " * 500]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    r = random.Random(2)
    words = sorted({w for t in texts() for w in (t or "").split()})
    some = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for k in range(40)]
    return index.query_terms(spark.createDataFrame([*some, (97, "the the of"), (98, "unknown words"), (99, None)], "item_id long, text string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_kept_index(spark, docs, queries, monkeypatch):
    monkeypatch.setattr(impact, "RANGE_DOCS", 8)
    whole, path = index.build(docs), shared_dir(spark, "impact")
    impact.build(whole, path)
    idx = impact.Impact(spark, path)
    assert rows(idx.postings.select("doc_id", "word", "tf", "doc_len")) == rows(whole.postings.select("doc_id", "word", "tf", "doc_len"))
    assert rows(idx.vocab.select("word", "df")) == rows(whole.vocab.select("word", "df")) and idx.figures.n_docs == whole.figures.n_docs
    for k in (1, 5, 1000):
        want = rows(candidates.bm25_topk(whole, queries, k))
        for prune in (True, False):
            assert rows(impact.Ranking(idx, queries, k, prune).run) == want
    few = impact.Ranking(idx, queries, 2, True)
    blocks, scored = few.share().agg(F.sum("blocks"), F.sum("scored")).first()
    assert scored < 0.7 * blocks
    order = [r.impact for r in idx.blocks.filter("word = 'the'").collect()]
    assert len(order) > 5 and max(order) >= order[0]


def test_index_is_built_in_one_pass(spark, docs, queries, monkeypatch):
    """Blocks are made once, without a pass that samples them first; slices, batches of one row and rows that share a doc_id, null too, change nothing."""
    monkeypatch.setattr(impact, "RANGE_DOCS", 8)
    sampled = []
    by_range = type(docs).repartitionByRange
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda self, *a: sampled.append(a) or by_range(self, *a))
    monkeypatch.setattr(impact, "parts", lambda *tables: 300, raising=False)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        again = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame([(None, "the of the"), (None, "of the the"), (10_000, "")], "doc_id long, text string"))
        whole, path = index.build(again), shared_dir(spark, "impact")
        idx = impact.build(whole, path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sampled == []
    plain = lambda x: sorted((str(r.doc_id), r.word, r.tf, r.doc_len) for r in x.collect())
    assert plain(idx.postings) == plain(whole.postings)
    assert len({r.f.rsplit("/", 1)[0] for r in idx.blocks.select(F.input_file_name().alias("f")).distinct().collect()}) == impact.BUCKETS
    assert idx.blocks.groupBy("word", "range").count().filter("count > 1").count() == 0
    assert idx.blocks.filter("n <> size(postings) or impact <= 0").count() == 0


def test_opened_index_reads_no_text(spark, docs, queries, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/documents.parquet"
    docs.write.parquet(table)
    made = []

    def make():
        made.append(1)
        return index.build(spark.read.parquet(table))

    one = impact.kept(spark, table, "text", make)
    two = impact.kept(spark, table, "text", make)
    assert made == [1] and one.path == two.path
    plan = impact.Ranking(two, queries, 5).run._jdf.queryExecution().toString() + two.postings_of(queries)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and f"{two.path}/blocks" in two.postings_of(queries).inputFiles()[0]
    asked = spark.createDataFrame([("the",)], "word string")
    assert "PartitionFilters: [isnotnull(bucket" in two.postings_of(asked)._jdf.queryExecution().toString() or "bucket" in two.postings_of(asked)._jdf.queryExecution().executedPlan().toString()
    docs.limit(10).write.mode("overwrite").parquet(table)
    assert impact.kept(spark, table, "text", make).figures.n_docs == 10 and made == [1, 1]
    session.forget()
    empty = impact.build(index.build(docs.limit(0)), shared_dir(spark, "impact"))
    assert impact.Ranking(empty, queries, 5, True).run.collect() == [] and impact.Ranking(empty, queries, 5).run.collect() == []


def vectors(n=300, dims=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    out = [(k, (centres[k % 6] + 0.2 * r.normal(size=dims)).tolist()) for k in range(n)]
    out += [(n + k, out[5][1]) for k in range(60)]  # copies
    return [*out, (900, None), (901, [0.1, None]), (902, [float("nan")] * dims), (903, []), (904, [0.5, -0.5]), (905, [0.0] * dims)]


def nearest_by_trial(data, k, metric, ids=None):
    valid = [(i, np.array(v + [0.0] * (8 - len(v)))) for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in valid:
        if ids is None or q in ids:
            score = {"dot": lambda b: a @ b, "l2": lambda b: -np.linalg.norm(a - b), "cosine": lambda b: a @ b / max(np.linalg.norm(a), 1e-10) / max(np.linalg.norm(b), 1e-10)}[metric]  # noqa: B023
            best = sorted(((round(float(score(b)), 6) + 0.0, i) for i, b in valid if i != q), reverse=True)
            out[q] = [(i, s) for s, i in best[:k]]
    return out


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
@pytest.mark.parametrize("sizes", [(4096, 512, 1 << 20), (32, 50, 90)])
def test_nearest_of_all(spark, metric, sizes, monkeypatch):
    for name, n in zip(("ROWS", "QUERIES", "GROUP_ROWS"), sizes, strict=True):
        monkeypatch.setattr(nearest, name, n)
    data = vectors()
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(4)
    got = {}
    for r in sorted(nearest.knn(df, df, 7, metric, drop_self=True).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = nearest_by_trial(data, 7, metric)
    assert set(got) == set(want)
    for q, x in want.items():  # scores that differ in their last bits only may change places
        assert np.allclose([s for _, s in got[q]], [s for _, s in x], atol=2e-6), q
        assert len({i for i, _ in got[q]}) == 7 and (metric != "dot" or got[q] == x), q


def test_nearest_of_names_and_nothing(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("é", [0.0, 1.0])], "id string, v array<float>")
    got = nearest.knn(df, df.filter("id = 'a'"), 2).collect()
    assert [(r.query_id, r.doc_id, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", "b", 1.0, 1), ("a", "a", 1.0, 2)]
    assert nearest.knn(df.limit(0), df, 2).collect() == [] and nearest.knn(df, df.limit(0), 2).collect() == []


def test_cells(spark, monkeypatch):
    data = vectors(900)
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(4)
    monkeypatch.setattr(nearest, "GROUP_ROWS", 64)
    cells = nearest.Cells(df, 12)
    assert cells.most > 1  # the cell of the copies is split
    ids = {k for k, _ in data if k % 5 == 0}
    want = nearest_by_trial(data, 10, "l2", ids)
    asked = df.filter("id % 5 = 0")
    for probes, least in ((12, 1.0), (4, 0.9)):
        got = {}
        for r in cells.search(asked, 10, probes, "l2", drop_self=True).collect():
            got.setdefault(r.query_id, []).append(r.score)
        close = [sum(s >= x[-1][1] - 2e-6 for s in got.get(q, [])) / len(x) for q, x in want.items()]
        assert np.mean(close) >= least - 1e-9, (probes, np.mean(close))
    assert nearest.Cells(df.limit(0), 4).search(asked, 3, 2).collect() == []


def held(docs, items):
    return sorted({(q, d) for d, t in docs for q, x in items if t is not None and x is not None and x in t})


@pytest.mark.parametrize("letters", [(1 << 19, 16 << 20), (40, 500)])
def test_containment(spark, letters, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_LETTERS", letters[0])
    monkeypatch.setattr(containment, "TAKE_LETTERS", letters[1])
    data = list(enumerate(texts(200)))
    data += [(700, "a" * 3000), (701, "naïve café \U0001f600 nul\x00 x"), (702, data[3][1])]
    r = random.Random(5)
    items = [(k, t[i : i + r.randint(1, 40)]) for k in range(60) if (t := data[r.randrange(200)][1]) for i in [r.randrange(len(t))]]
    items += [(100, "the"), (101, " the"), (102, "the "), (103, ""), (104, None), (105, "a" * 50), (106, "é \U0001f600"), (107, "nul\x00"), (108, "the"), (109, data[3][1]), (110, "never said")]
    docs = spark.createDataFrame([*data, data[5]], "doc_id long, text string").repartition(3)
    named = spark.createDataFrame(items, "query_id long, text string")
    assert rows(containment.containing(docs, named)) == held(data, items)
    assert containment.containing(docs, named.limit(0)).collect() == [] and containment.containing(docs.limit(0), named).collect() == []


def test_broadcasts_by_what_rows_are(spark, monkeypatch):
    """A text that repeats takes little of a file, but as much memory as any."""
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().logical().toString()
    many = spark.range(4000).select("id", F.lit("x" * 1000).alias("t"))
    assert hinted(session.bounded(many)) and hinted(session.bounded(spark.range(0)))
    monkeypatch.setattr(session, "BROADCAST_WHOLE", 1 << 20)
    assert not hinted(session.bounded(many)) and hinted(session.bounded(many.select("id")))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 10)
    assert not hinted(session.bounded(many.select("id")))


@pytest.mark.parametrize("sizes", [(1024, 4096), (3, 2)])
def test_quantiles(spark, sizes, monkeypatch):
    monkeypatch.setattr(sampling, "BRACKETS", sizes[0])
    monkeypatch.setattr(sampling, "FEW_VALUES", sizes[1])
    r = random.Random(8)
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)
    for values in ([r.gauss(0, 1) ** 3 for _ in range(300)], [7.0] * 200 + [1.0, 9.0], [1e308, -1e308, 0.0, 5e-324], [3.0], [float("-inf"), float("inf"), 1.0, 2.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
        got = {x.quantile: x.value for x in sampling.quantiles(df, "v", at).collect()}
        s = sorted(values)
        for q in at:
            p = q * (len(s) - 1)
            a, b = s[int(p)], s[-int(-p // 1)]
            assert got[q] == (a if a == b else a + (b - a) * (p - int(p))) or (got[q] != got[q]), (q, values[:3])
    assert {x.value for x in sampling.quantiles(df.limit(0), "v", at).collect()} == {None}


def test_word_pairs_of_long_turns(spark, monkeypatch):
    """Parts of target words change nothing."""
    r = random.Random(9)
    say = lambda n: [r.choice("abcdefghij") for _ in range(n)]
    df = spark.createDataFrame([(k, say(r.randint(1, 9)), say(r.randint(1, 30))) for k in range(30)], "pair long, src array<string>, dst array<string>")
    want = {(x.src, x.dst): x.p for x in tranmodel.train(df, 3).collect()}
    monkeypatch.setattr(tranmodel, "PART_WORDS", 4)
    got = {(x.src, x.dst): x.p for x in tranmodel.train(df, 3).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(sum(p for (src, _), p in got.items() if src == "a") - 1) < 1e-9
