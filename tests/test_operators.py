"""Operators that SQL can't check, against plain counterparts; models, trainers, formats, orders."""

import math
import random
import re
from urllib.parse import unquote_plus

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklode.functions import parse as P
from ranklode.functions import text as T
from ranklode.operators import boosting, candidates, ltr, ordering, sampling, stages, trees
from ranklode.plans import QUERIES
from ranklode.sources import converters, files, formats, models

SF = "/root/testdata/sf0.001"


def ndcg(grades, scores, ids, k):
    order = sorted(range(len(grades)), key=lambda i: (-round(scores[i], 9), -ids[i]))
    dcg = lambda g: sum((2.0**x - 1) / math.log2(i + 2) for i, x in enumerate(g[:k]))
    ideal = dcg(sorted(grades, reverse=True))
    return dcg([grades[i] for i in order]) / ideal if ideal > 0 else 0.0


@pytest.fixture(scope="module")
def ranked():
    r = random.Random(31)
    rows = []
    for q in range(30):
        for d in range(r.randint(3, 9)):
            x = [r.random(), round(r.random(), 1), r.gauss(0, 2)]
            rows.append((q, 100 * q + d, float(min(2, max(0, round(2 * x[0] + x[1] - 0.6 + r.gauss(0, 0.3))))), x))
    return rows


@pytest.fixture(scope="module")
def frame(spark, ranked):
    return spark.createDataFrame(ranked, "query_id long, doc_id long, grade double, feats array<double>").cache()


def by_query(rows):
    out = {}
    for q, d, g, x in rows:
        out.setdefault(q, []).append((d, g, np.array(x)))
    return out


def mean_ndcg(rows, score, k):
    return float(np.mean([ndcg([g for _, g, _ in v], [score(x) for _, _, x in v], [d for d, _, _ in v], k) for v in by_query(rows).values()]))


# --- trees ------------------------------------------------------------------------------


def tree_by_trial(x, y, leaves):
    """Least squares tree by leaves, each split by trial of every value."""
    parts = [np.arange(len(y))]
    tree = {0: None}
    sse = lambda i: float(((y[i] - y[i].mean()) ** 2).sum())
    splits, stuck = [], set()
    while len(parts) < leaves and len(stuck) < len(parts):
        at = max((k for k in range(len(parts)) if k not in stuck), key=lambda k: (sse(parts[k]), -k))
        i = parts[at]
        best = None
        for f in range(x.shape[1]):
            for t in np.unique(x[i, f])[:-1]:
                left, right = i[x[i, f] <= t], i[x[i, f] > t]
                gain = sse(i) - sse(left) - sse(right)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, right)
        if best is None:
            stuck.add(at)
            continue
        parts[at] = best[1]
        parts.append(best[2])
        splits.append(best[0])
    out = np.zeros(len(y))
    for i in parts:
        out[i] = y[i].mean()
    return out, tree


def test_a_tree_is_grown_as_by_trial(spark, ranked, frame):
    x, y = np.array([r[3] for r in ranked]), np.array([r[2] for r in ranked])
    edges = trees.thresholds(frame, 1000)
    assert [len(e) for e in edges] == [len(np.unique(x[:, f])) for f in range(3)]
    rows = trees.binned(frame, edges).withColumn("y", F.col("grade"))
    for leaves in (2, 5, 9):
        tree = [{"weight": 1.0, "tree": trees.outer(trees.grown(rows, edges, leaves), edges)}]
        got = {r.doc_id: r.s for r in frame.select("doc_id", ltr.tree_score(tree).alias("s")).collect()}
        want, _ = tree_by_trial(x, y, leaves)
        assert np.allclose([got[r[1]] for r in ranked], want)


def test_few_thresholds_are_evenly_spaced(frame):
    edges = trees.thresholds(frame, 8)
    assert all(len(e) <= 11 for e in edges) and len(edges[0]) == 8 and np.allclose(np.diff(edges[0]), np.diff(edges[0])[0])


def test_boosted_trees_learn(frame, ranked):
    one = models.train("MART", frame, trees=1, leaves=4, rate=1.0)
    x, y = np.array([r[3] for r in ranked]), np.array([r[2] for r in ranked])
    first, _ = tree_by_trial(x, y, 4)
    got = {r.doc_id: r.s for r in frame.select("doc_id", one.score().alias("s")).collect()}
    assert np.allclose([got[r[1]] for r in ranked], first)
    train, valid = trees.held_out(frame, 0.3)
    model = trees.lambda_mart(train, trees=4, leaves=5, valid=valid, patience=2)
    before = mean_ndcg(ranked, lambda v: 0.0, 10)
    assert 1 <= len(model) <= 4 and ltr.mean_ndcg(frame, [ltr.tree_score(model)], 10)[0] > before + 0.05
    # a leaf's value is a Newton step on the rows of the leaf
    g = {r.doc_id: (r.lam, r.weight) for r in ltr.lambdas(train.withColumn("score", F.lit(0.0)), 10).collect()}
    leaf = {r.doc_id: r.s for r in train.select("doc_id", ltr.tree_score([{"weight": 1.0, "tree": model[0]["tree"]}]).alias("s")).collect()}
    for value in set(leaf.values()):
        some = [g.get(d, (0.0, 0.0)) for d, s in leaf.items() if s == value]
        assert abs(value - sum(a for a, _ in some) / max(sum(b for _, b in some), 1e-300)) < 1e-6 or not sum(b for _, b in some)


def test_forests_are_means_of_bags(frame):
    a, b = (models.train(8, frame, bags=n, leaves=3, seed=n) for n in (1, 2))
    both = models.combined([a, b])
    assert len(both.body) == 3
    got = frame.select(both.score().alias("x"), ((a.score() + 2 * b.score()) / 3).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        models.combined([a, models.Model("MART", [])])


# --- boosting ---------------------------------------------------------------------------


def test_ada_rank_as_by_hand(frame, ranked):
    got = boosting.ada_rank(frame, rounds=4, k=5)
    groups = by_query(ranked)
    per = lambda score: {q: ndcg([g for _, g, _ in v], [score(x) for _, _, x in v], [d for d, _, _ in v], 5) for q, v in groups.items()}
    weak = [per(lambda x, f=f: x[f]) for f in range(3)]
    p, model, last = {q: 1 / len(groups) for q in groups}, [], -1.0
    for _ in range(4):
        f = max(range(3), key=lambda f: (round(sum(p[q] * weak[f][q] for q in p), 12), -f))
        alpha = 0.5 * math.log(sum(p[q] * (1 + weak[f][q]) for q in p) / sum(p[q] * (1 - weak[f][q]) for q in p))
        trial = [*model, (f + 1, alpha)]
        served = per(lambda x, trial=trial: sum(a * x[k - 1] for k, a in trial))
        value, total = np.mean(list(served.values())), sum(math.exp(-alpha * v) for v in served.values())
        if value + 0.002 - last <= 0:
            break
        model, last = trial, value
        p = {q: p[q] * math.exp(-alpha * served[q]) / total for q in p}
    assert [f for f, _ in got] == [f for f, _ in model] and np.allclose([a for _, a in got], [a for _, a in model], atol=1e-6)


def test_rank_boost_as_with_pairs(frame, ranked):
    got = boosting.rank_boost(frame, rounds=5, n_thresholds=6)
    x = {d: v for _, d, _, v in ranked}
    pairs = [(a[1], b[1]) for a in ranked for b in ranked if a[0] == b[0] and a[2] > b[2]]
    weight = dict.fromkeys(pairs, 1 / len(pairs))
    values = np.array([r[3] for r in ranked])
    edges = [[*(values[:, f].max() - j * (values[:, f].max() - values[:, f].min()) / 6 for j in range(6)), values[:, f].min() - 1e8] for f in range(3)]
    for f, threshold, alpha in got:
        r = lambda f, t: sum(w * (float(x[a][f] > t) - float(x[b][f] > t)) for (a, b), w in weight.items())
        best = max(r(g, t) for g in range(3) for t in edges[g])
        mine = r(f - 1, threshold)
        assert abs(mine - best) < 1e-9 and abs(alpha - 0.5 * math.log((1 + mine) / (1 - mine))) < 1e-6
        weight = {(a, b): w * math.exp(alpha * (float(x[b][f - 1] > threshold) - float(x[a][f - 1] > threshold))) for (a, b), w in weight.items()}
        total = sum(weight.values())
        weight = {k: w / total for k, w in weight.items()}
    assert len(got) == 5


@pytest.mark.parametrize("kind", ["ranknet", "lambdarank", "listnet"])
def test_gradients_are_slopes_of_the_loss(kind, frame, ranked):
    r = np.random.Generator(np.random.PCG64(5))
    w = [r.normal(size=(3, 1))] if kind == "listnet" else [r.normal(size=(3, 4)), r.normal(size=4), r.normal(size=4), np.zeros(1)]
    x, g = r.normal(size=(6, 3)), np.array([0.0, 1, 2, 1, 0, 2])

    def loss(w):
        s = x @ w[0][:, 0] if len(w) == 1 else 1 / (1 + np.exp(-(x @ w[0] + w[1]))) @ w[2] + w[3][0]
        if kind == "listnet":
            p, q = (np.exp(v) / np.exp(v).sum() for v in (g, s))
            return -(p * np.log(q)).sum()
        return sum(math.log1p(math.exp(-(s[i] - s[j]))) for i in range(6) for j in range(6) if g[i] > g[j])

    if kind != "lambdarank":  # its gradient is no slope of a function
        got, _ = boosting._gradient(kind, w, x, g, 10)
        for k, v in enumerate(w):
            for at in np.ndindex(v.shape):
                up, down = ([u.copy() for u in w] for _ in range(2))
                up[k][at] += 1e-6
                down[k][at] -= 1e-6
                assert abs(got[k][at] - (loss(up) - loss(down)) / 2e-6) < 1e-4
    first, trained = (boosting.neural(frame, kind, epochs=n, rate=1.0) for n in (0, 8))
    scores = frame.select(boosting.neural_score(trained).alias("s"))
    assert scores.filter("s is null or isnan(s)").count() == 0
    before, after = ltr.mean_ndcg(frame, [boosting.neural_score(first), boosting.neural_score(trained)], 10)
    assert after > before


def test_coordinate_ascent_as_by_hand(frame, ranked):
    w, value = ltr.coordinate_ascent(frame, k=5, restarts=1, iterations=2, levels=3)
    assert abs(value - mean_ndcg(ranked, lambda x: float(np.dot(w, x)), 5)) < 1e-9
    assert value >= mean_ndcg(ranked, lambda x: float(x.sum()) / 3, 5) and abs(sum(map(abs, w)) - 1) < 1e-6


def test_model_files(spark, frame, tmp_path):
    for m in (models.train("AdaRank", frame, rounds=2), models.train("RankBoost", frame, rounds=2), models.train("LambdaMART", frame, trees=2, leaves=3), models.train(8, frame, bags=2, leaves=3), models.train(9, frame), models.train(4, frame, restarts=1, iterations=1, levels=1)):
        path = f"file://{tmp_path}/{m.kind.replace(' ', '')}"
        models.save(spark, m, path)
        again = models.load(spark, path)
        assert again.kind == m.kind
        assert all(abs(r.a - r.b) < 1e-9 for r in frame.select(m.score().alias("a"), again.score().alias("b")).collect())
    with pytest.raises(ValueError, match="unknown model kind"):
        models.parse("## No such ranker\n1:2")
    folds = models.cross_validated(frame, "Linear Regression", 3, normalize="linear")
    assert len(folds) == 3 and all(0 < v <= 1 for v in folds)
    assert models.ranked(frame, models.train(9, frame), 2).filter("rank > 2").count() == 0


def test_permutations_by_hand(spark):
    r = random.Random(3)
    a = [(q, r.random()) for q in range(12)]
    b = [(q, v + r.gauss(0.05, 0.1)) for q, v in a]
    from ranklode.operators import evaluate as E

    got = E.permutation_test(*(spark.createDataFrame(x, "query_id long, m double") for x in (a, b)), "m", 2000).first()
    d = np.array([x[1] - y[1] for x, y in zip(a, b, strict=True)])
    signs = np.random.Generator(np.random.PCG64(1)).choice([-1, 1], (20_000, 12))
    assert abs(got.observed - d.mean()) < 1e-9 and abs(got.p_value - (np.abs((signs * d).mean(1)) >= abs(d.mean()) - 1e-12).mean()) < 0.04


# --- orders, containment, parsers -------------------------------------------------------


def test_places_and_running_sums(spark):
    r = random.Random(6)
    data = [(f"k{r.randrange(10**6)}-{i}", r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, n long").repartition(7)
    got = {x.k: x.place for x in ordering.numbered(df, "k").collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(data), 1)}
    x, ranges = ordering.running(df, "n", "k")
    upto, total = {y.k: y.upto for y in x.collect()}, 0
    for k, n in sorted(data):
        total += n
        assert upto[k] == total
    assert sum(n for _, _, n in ranges) == total
    assert ordering.numbered(df.limit(0), "k").collect() == [] and ordering.running(df.limit(0), "n", "k")[0].collect() == []


def test_containment(spark):
    r = random.Random(8)
    words = ["a", "bb", "ccc", "d.", "é", "the"]
    texts = [r.choice(["", " ", "\n"]).join(r.choice(words) + r.choice([" ", "  ", "\t", ""]) for _ in range(r.randint(0, 30))) for _ in range(80)] + [None, "", "a bb ccc"]
    items = [t[i : i + r.randint(0, 25)] for t in texts[:60] if t for i in [r.randrange(len(t))]] + ["", None, "zz zz zz", " a ", "bb"]
    d, q = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "query_id long, text string")
    got = sorted(tuple(x) for x in candidates.containing(d, q).collect())
    assert got == sorted((i, j) for i, a in enumerate(items) for j, b in enumerate(texts) if a is not None and b is not None and a in b)


def test_overlap_by_rare_words(spark):
    r = random.Random(9)
    words = ["the", "of"] + [f"w{i}" for i in range(25)]
    say = lambda: " ".join(r.choice(words[:6] if r.random() < 0.5 else words) for _ in range(r.randint(0, 12)))
    a, b = [(i, say()) for i in range(50)], [(i, say()) for i in range(60)] + [(99, None)]
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    for least in (0.3, 0.5, 1.0):
        got = {(x.a_id, x.b_id): x.jaccard for x in sampling.token_overlap(*(spark.createDataFrame(x, "id long, text string") for x in (a, b)), least).collect()}
        want = {(i, j): jaccard(set(x.split()), set((y or "").split())) for i, x in a for j, y in b}
        assert {k for k in got} == {k for k, v in want.items() if v >= least and v > 0} and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_url_words(spark):
    urls = ["https://www.a.com/x-y%20z?q=1+2", "http://b.org/%C3%A9/%zz", "c d", None, "https://http://e.f/"]
    got = [r.w for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.pretokenize_url("u").alias("w")).collect()]
    assert got[0] == "a com x y z q 1 2" and got[2] == "c d" and got[3] is None and got[4] == "e f"
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    want = {p.page_id: " ".join(re.sub(r"[!-/:-@\[-`{-~]+", " ", re.sub(r"^(https?://|www\.)+", "", unquote_plus(p.url))).split(" ")).strip() for p in pages}
    assert {r.page_id: r.words for r in QUERIES["t14_url_words"](spark, SF).collect()} == {k: re.sub(" +", " ", v) for k, v in want.items()}


def test_stems_and_lemmas(spark):
    df = spark.createDataFrame([("This IS a simplest tests",), ("This IS a simplest#teStEd",), ("running studies, boxes & classes; planned bus",), (None,)], "t string")
    assert [r.s for r in df.select(P.stemmed("t", ["is", "a"]).alias("s")).collect()] == ["this simplest test", "this simplest test", "run study box class plan bus", None]
    P.lemmatizer("upper")(lambda: lambda tokens: [t.upper() for t in tokens])
    got = df.select(P.parsed("t", "upper", ["IS"], alphanumeric=True, lower=False).alias("p")).select("p.*").collect()
    assert got[0].lemmas == "THIS A SIMPLEST TESTS" and got[0].tokens == "This a simplest tests" and got[3].lemmas == ""
    pieces = df.select(P.subwords("t", "/opt/tokenizers/piece_bpe_32k.model").alias("p")).collect()
    assert pieces[0].p.replace(" ", "").replace("▁", " ").strip() == "This IS a simplest tests" and pieces[3].p == ""


def test_records_and_xml(spark):
    df = spark.createDataFrame([("<document><uri>7</uri><subject>Why &amp; <b>how</b></subject><bestanswer>y</bestanswer><nbestanswers><answer_item>x</answer_item><answer_item>y</answer_item></nbestanswers></document>",)], "r string")
    q = df.select(P.qa_record("r").alias("q")).first().q
    assert (q.uri, q.content, q.best, q.answers) == ("7", "", 1, ["x", "y"]) and q.subject.split() == ["Why", "&", "how"]
    with pytest.raises(Exception, match="without uri"):
        df.select(P.qa_record(F.lit("<document></document>")).alias("q")).collect()
    x = spark.createDataFrame([("a<b\x01&c", None)], "t string, n string").select(P.xml_entry("DOC", DOCNO="t", body="n").alias("x"), P.without_xml_header(F.lit("<?xml version='1.0'?>\n<a/>")).alias("h")).first()
    assert x.x == "<DOC><DOCNO>a&lt;b&amp;c</DOCNO><body></body></DOC>" and x.h == "<a/>"
    h = spark.createDataFrame([(b"<title>T</title><p>a\xff b</p>", "text/html"), (b"plain <p>", "text/plain"), (b"x", "image/png")], "b binary, k string").select(P.html_document("b", "k", 40).alias("d")).collect()
    assert [r.d.body.strip() for r in h] == ["a� b", "plain <p>", ""] and h[0].d.title == "T"
    assert spark.range(1).select(P.charset(F.lit("Content-Type: text/html; charset=utf-8\r\nX: y")).alias("c")).first().c == "utf-8"


def test_stages(spark):
    df = spark.createDataFrame([(1, "A b", None)], "k long, x string, y string")
    out = stages.run(df, "k", [[("copy", {"fields": ["x", "y"]}), ("lower", {"fields": {"x": "z"}})], [("concat", {"fields": ["z", "y"], "output": "t"})]])
    assert out.columns == ["k", "t"] and out.first().t == "a b "
    with pytest.raises(ValueError, match="several components"):
        stages.run(df, "k", [[("copy", {"fields": ["x"]}), ("rename", {"mapping": {"y": "x"}})]])
    with pytest.raises(ValueError, match="no component"):
        stages.run(df, "k", [[("nothing", {})]])


# --- formats ----------------------------------------------------------------------------


def test_discovery(spark, tmp_path):
    import gzip

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    with gzip.open(tmp_path / "a/data.jsonl.gz", "wt") as f:
        f.write('{"DOCNO": "1", "text": "x"}\n{"DOCNO": "2", "text": "y"}\n')
    with gzip.open(tmp_path / "b/questions.jsonl.gz", "wt") as f:
        f.write('{"DOCNO": "q"}\n')
    top = f"file://{tmp_path}"
    assert formats.data_folders(spark, top, "data.jsonl", "questions.jsonl") == (["a"], ["b"], ".gz")
    path = formats.variant(spark, f"{top}/a/data.jsonl")
    assert path.endswith(".gz") and formats.entry_format(path) == "text" and formats.entry_format("x.bin.bz2") == "binary"
    assert formats.entries(spark, path, "DOCNO string, text string").count() == 2
    assert {r.DOCNO for r in formats.queries(spark, path, "text").collect()} == {"1", "2"}
    assert formats.matching_lines(spark, f"{top}/a", r".*\.gz").count() == 2 and formats.matching_lines(spark, f"{top}/a", "no").count() == 0
    (tmp_path / "a/data.jsonl").write_text('{"DOCNO": "3"}\n')
    for bad in (f"{top}/a/data.jsonl", f"{top}/a/none.jsonl"):
        with pytest.raises(FileNotFoundError):
            formats.variant(spark, bad)
    with pytest.raises(ValueError, match="different ways"):
        formats.data_folders(spark, top, "data.jsonl", "questions.jsonl")
    with pytest.raises(ValueError, match="unknown entry format"):
        formats.entry_format("x.txt")


def test_codecs(spark, tmp_path):
    df = spark.createDataFrame([([1, 4], [2, 1], [4, 1, 1], 3), ([], [], None, 0)], "ids array<int>, counts array<int>, positions array<int>, length int")
    want = [tuple(r) for r in df.collect()]
    assert [r.t for r in df.select(formats.to_entry_text().alias("t")).collect()] == ["1:2 4:1@4 1 1@3", "@@0"]
    assert [tuple(r.e) for r in df.select(formats.to_entry_text().alias("t")).select(formats.from_entry_text("t").alias("e")).collect()] == want
    again = df.select(formats.entry_bytes("ids", "counts", "positions", "length").alias("b")).select(formats.entry_of_bytes("b").alias("e"))
    assert [tuple(r.e) for r in again.collect()] == want
    v = spark.createDataFrame([("d", [5, 2], [0.5, 1.5])], "k string, ids array<int>, v array<float>").withColumn("b", formats.pack_sparse("ids", "v"))
    assert [(x.id, x.val) for x in v.select(files.sparse_from_packed("b").alias("s")).first().s] == [(2, 1.5), (5, 0.5)]
    (tmp_path / "x.bin").write_bytes(v.select(formats.pack_entry("k", F.lit("vec"), "b").alias("e"), "b").first().e)
    back = formats.entries(spark, f"file://{tmp_path}/x.bin", "DOCNO string").first()
    assert (back.DOCNO, back.field, bytes(back.value)) == ("d", "vec", bytes(v.first().b))
    assert np.frombuffer(formats.component_header([(True, 9), (False, 64)]), "<i4").tolist() == [2, 1, 0, 0, 64]


def test_tables_and_reports(spark, tmp_path):
    (tmp_path / "g.txt").write_text("cat;1;2.5\ndog;0;-1\n")
    assert [(r.key, r.v) for r in formats.number_table(spark, f"file://{tmp_path}/g.txt", ";").collect()] == [("cat", [1.0, 2.5]), ("dog", [0.0, -1.0])]
    text = formats.report_text({"map": 0.25, "queries": 3})
    assert formats.report_value(text, "map") == 0.25 and formats.report_table({"a": {"map": 0.25}, "b": {"mrr": 1.0}}) == "run\tmap\tmrr\na\t0.250000\t\nb\t\t1.000000\n"
    with pytest.raises(ValueError):
        formats.report_value(text, "ndcg")
    pairs = spark.createDataFrame([("q", "d"), ("q", "e"), ("q", "d"), ("r", "d")], "query_id string, doc_id string")
    formats.write_pairs(pairs, f"file://{tmp_path}/p", keep_queries=spark.createDataFrame([("q",)], "id string"))
    assert sorted(tuple(r) for r in files.training_pairs(spark, f"file://{tmp_path}/p").collect()) == [("q", "d", 0.0), ("q", "e", 0.0)]
    texts = lambda *x: spark.createDataFrame(list(x), "id string, text string")
    sampling.export_training(texts(("q", "ask"), ("r", "  ")), texts(("d", "one"), ("e", "two"), ("z", "no")), pairs, f"file://{tmp_path}/t")
    q, d = files.training_texts(spark, f"file://{tmp_path}/t/texts")
    assert {r.id for r in q.collect()} == {"q"} and {r.id for r in d.collect()} == {"d", "e"}


def test_samplers_and_swaps(spark):
    rows = [(q, 10 * q + d, d < 2) for q in range(3) for d in range(2 + q + 1)]
    got = sampling.by_query(spark.createDataFrame(rows, "query_id long, doc_id long, positive boolean"), 2).collect()
    for q in range(3):
        mine = sorted((r.step, r.pos_id, r.neg_id) for r in got if r.query_id == q)
        assert [s for s, _, _ in mine] == [0, 1, 2, 3] and mine[0][1] == mine[1][1] != mine[2][1]
        assert len({n for _, _, n in mine}) == min(q + 1, 4)
    e = lambda *x: spark.createDataFrame([(i, "t") for i in x], "id string, text string")
    j = lambda *x: spark.createDataFrame([(i, "d", 1.0) for i in x], "query_id string, doc_id string, grade double")
    texts, qrels, run = sampling.replaced_validation(e("a", "b"), j("a", "v"), j("v"), spark.createDataFrame([("v",)], "query_id string"), e("b", "c"), j("w"), j("w"))
    assert {r.id for r in texts.collect()} == {"a", "b", "c"} and texts.count() == 3
    assert {r.query_id for r in qrels.collect()} == {"a", "w"} and {r.query_id for r in run.collect()} == {"w"}


def test_converters(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    d = converters.documents(lines("D1\thttp://www.a.com/b\tTitle X\tBody  Y", "bad\tline")).collect()
    assert len(d) == 1 and (d[0].DOCNO, d[0].url, d[0].text, d[0].text_raw) == ("D1", "a com b", "a com b title x body y", "http://www.a.com/b Title X Body  Y")
    q, j = converters.clicks(lines("1\tBig Cat\tD1\tu", "1\tBig Cat\tD2\tu", "2\t \tD3\tu", "3\tdog\tD4\tu"), ignore=spark.createDataFrame([("dog",)], "text string"))
    assert [(r.DOCNO, r.text) for r in q.collect()] == [("orcas_1", "big cat")] and {r.doc_id for r in j.collect()} == {"D1", "D2"}
    v2 = converters.documents_v2(lines('{"docid": "m1", "url": "http://x.y", "title": "T", "headings": "H", "body": "B"}', "{}")).collect()
    assert [(r.DOCNO, r.text) for r in v2] == [("m1", "x y h t b")]
    p = converters.passages_v2(lines('{"pid": "p", "passage": "A B", "docid": "m1"}')).first()
    assert (p.DOCNO, p.text, p.parent) == ("p", "a b", "m1")
    w = converters.encyclopedia_passages(lines("id\ttext\ttitle", "1\tSome Text\tIts Title", "2\tx\ty"), keep=spark.createDataFrame([("1",)], "id string")).collect()
    assert [(r.DOCNO, r.text) for r in w] == [("1", "its title some text")]
    assert converters.queries(lines("1\tone", "2\ttwo words"), 2).first().DOCNO == "2"
    a = converters.abstracts(spark.createDataFrame([(1, "T", "A", "S", "B")], "id int, title string, author string, source string, body string")).first()
    assert (a.DOCNO, a.text) == ("1", "t a s b")


def test_faults_of_a_run_file(spark, tmp_path):
    (tmp_path / "run").write_text("q Q0 d 1 2.5 a\nq Q0 e 2 2.0 a\nq Q0 f 3\nq Q0 g 4 1.0 b\n")
    got = sorted(tuple(r) for r in files.run_file_faults(spark, f"file://{tmp_path}/run").collect())
    assert got == [("q Q0 f 3", "not six columns"), ("q Q0 g 4 1.0 b", "another run id")]
