"""Further operators: parsers, field pipelines, feedback and translation scores, model files,
exports, converters, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklode.functions import parse as P
from ranklode.functions import text as T
from ranklode.functions import vectors as V
from ranklode.operators import candidates as C
from ranklode.operators import evaluate as E
from ranklode.operators import features as X
from ranklode.operators import index as I
from ranklode.operators import ltr as R
from ranklode.operators import matching as D
from ranklode.operators import sampling as S
from ranklode.operators import scoring, stages
from ranklode.operators import tranmodel as M
from ranklode.plans.learning import FEATS, GROUPS, TREES, feature_rows, groups
from ranklode.plans.more import SOFT
from ranklode.plans.preparation import BITEXT, LINK, RESCALED, WHOLE, W, bitext, entities
from ranklode.plans.registry import SQL, query
from ranklode.plans.retrieval import DOCS, EMB, EVAL, KNN, LG, L, NORM, QRELS, RUN, TERMS, WT, index, line_grades, line_run, qrels, query_tokens, rounded, run, terms, vectors, weighed
from ranklode.session import bounded, shared_dir
from ranklode.sources import converters, models

# --- parsers and pipelines --------------------------------------------------------------

STOP = ["the", "of", "and"]


def _stem_sql(x: str) -> str:
    x = f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    x = f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN ('the', 'of', 'and')), ' ')"
    for pattern, by in P.STEMS:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return x


@query(f"SELECT item_id, {_stem_sql('text')} AS text FROM benchmark UNION ALL SELECT doc_id, {_stem_sql('text')} FROM documents")
def t11_stems(t):
    return t.benchmark.select("item_id", P.stemmed("text", STOP).alias("text")).union(t.documents.select("doc_id", P.stemmed("text", STOP)))


@query(None)
def t12_lemmas(t):
    x = t.documents.select("doc_id", P.parsed("text", "same", STOP, alphanumeric=True).alias("p"))
    return x.select("doc_id", "p.lemmas", "p.tokens")


@query(None)
def t11_porter_stems(t):
    return t.documents.select("doc_id", P.porter_stemmed("text", ["the", "of", "and"]).alias("stems"))


@query(None)
def t15_subwords(t):
    return t.benchmark.select("item_id", P.subwords("text", "/opt/tokenizers/piece_bpe_32k.model").alias("pieces"))


_HTML = SQL["t16_html_text"].split("SELECT page_id, ", 1)[1].rsplit(" AS text FROM pages", 1)[0].replace("regexp_replace(html,", "regexp_replace(substring(html, 1, 32768),")
_TITLE = SQL["t16_html_title_links"].split("SELECT page_id, ", 1)[1].split(" AS title", 1)[0].replace("regexp_extract(html,", "regexp_extract(substring(html, 1, 32768),")


@query(f"SELECT page_id, CASE WHEN html LIKE '<%' THEN {_HTML} ELSE substring(html, 1, 32768) END AS body, CASE WHEN html LIKE '<%' THEN {_TITLE} ELSE '' END AS title FROM pages")
def t17_html_documents(t):
    """What begins with a tag is HTML, anything else plain text."""
    kind = F.when(F.col("html").startswith("<"), "text/html").otherwise("text/plain")
    x = t.pages.select("page_id", P.html_document(F.col("html").cast("binary"), kind).alias("d"))
    return x.select("page_id", "d.body", "d.title")


@query("SELECT item_id::VARCHAR AS uri, trim(text) AS subject, 'a b' AS content, 1 AS best, 2 AS answers FROM benchmark")
def t21_question_records(t):
    record = F.concat(F.lit("<document><uri>"), "item_id", F.lit("</uri><subject>"), "text", F.lit("</subject><content>a&lt;br/&gt;b</content><bestanswer>two &amp; two</bestanswer><nbestanswers><answer_item>one</answer_item><answer_item>two &amp; two</answer_item></nbestanswers></document>"))
    x = t.benchmark.select(P.qa_record(record).alias("q"))
    return x.select("q.uri", "q.subject", "q.content", "q.best", F.size("q.answers").alias("answers"))


@query("SELECT p_partkey AS docno, p_name || ' ' || coalesce(p_type, '') AS text, lower(p_brand) AS brand FROM part")
def p6_stages(t):
    plan = [
        [("copy", {"fields": ["p_name", "p_type", "p_brand"]})],
        [("rename", {"mapping": {"p_name": "title", "p_type": "body", "p_brand": "brand"}})],
        [("concat", {"fields": ["title", "body"], "output": "text"}), ("lower", {"fields": {"brand": "brand"}})],
    ]
    return stages.run(t.part, "p_partkey", plan).withColumnRenamed("p_partkey", "docno")


@query("SELECT id, array_to_string(list_transform(v, lambda x: floor(256 * x)::INT), ' ') AS text, array_to_string(list_transform(range(len(v)), lambda x: label), ',') AS filled FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)")
def t24_vector_text(t):
    """Vectors as text: their components as integers, and as many times their label."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("int"))
    return t.embeddings.select(F.col("vec_id").alias("id"), V.to_text(whole).alias("text"), V.to_text(F.array_repeat("label", F.size("embedding")), ",").alias("filled"))


_ATT = "ae AS (SELECT g, vs, list_transform(vs, lambda v: exp(list_dot_product(v, vs[1]) - list_max(list_transform(vs, lambda u: list_dot_product(u, vs[1]))))) AS e FROM vg),"


@query("SELECT g, [round(list_sum([vs[i][k] * e[i] for i in range(1, len(vs) + 1)]) / list_sum(e), 6) for k in range(1, 65)] AS v FROM ae", GROUPS + _ATT)
def v_attention(t):
    return groups(t).select("g", F.transform(scoring.attention("vs", F.col("vs")[0]), lambda x: V.rounded(x)).alias("v"))


@query("SELECT g, [round((vs[1][k] + coalesce(vs[3][k], 0) + coalesce(vs[5][k], 0)) / ((len(vs) + 1) // 2), 6) for k in range(1, 65)] AS v FROM vg", GROUPS)
def t25_masked_pooling(t):
    mask = F.transform("vs", lambda _, i: (i + 1) % 2)
    return groups(t).select("g", F.transform(V.mean_pool("vs", mask), lambda x: V.rounded(x)).alias("v"))


@query(r"SELECT doc_id, regexp_replace(text, '[\n\r]+', ' ', 'g') AS one_line, regexp_replace(text, '\t', ' ', 'g') AS no_tabs FROM documents")
def t9_spaces(t):
    return t.documents.select("doc_id", T.newlines_to_spaces("text").alias("one_line"), T.tabs_to_spaces("text").alias("no_tabs"))


@query(f"SELECT page_id, array_to_string(list_transform(regexp_extract_all({WHOLE}, '{LINK}', 2), lambda x: trim({entities('x')})), ' ') AS anchors FROM pages".replace("trim(regexp_replace(", "trim(regexp_replace(", 1))
def t19_anchor_text(t):
    return t.pages.select("page_id", T.anchor_text("html").alias("anchors"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 7::BIGINT AS missing FROM events")
def t23_json_default(t):
    return t.events.select("event_id", T.json_attribute("props", "k", "long").alias("k"), T.json_attribute("props", "absent", "long", 7).alias("missing"))


# --- candidates and features ------------------------------------------------------------


@query("SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INT AS rank FROM (SELECT a.id AS query_id, b.id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)) WHERE rank <= 10", EMB)
def c7_knn_cosine(t):
    return C.knn(vectors(t), vectors(t).filter("id % 50 = 0"), 10, "cosine", drop_self=True)


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 7")
def l7_first_queries(t):
    """The option that takes the first queries only, in order of their ids."""
    return C.first(t.benchmark, "item_id", 7)


@query("""SELECT query_id, doc_id, round(coalesce(h, 0) / greatest(known, 1.0), 6) AS overlap FROM run JOIN qi USING (query_id)
 LEFT JOIN (SELECT query_id, doc_id AS parent, sum(qtf) AS h FROM m GROUP BY ALL) p USING (query_id) WHERE p.parent = doc_id - doc_id % 5
 UNION ALL SELECT query_id, doc_id, 0.0 FROM run WHERE (query_id, doc_id - doc_id % 5) NOT IN (SELECT (query_id, doc_id) FROM m)""", RUN + WT)
def j4_features_of_parents(t):
    of = weighed(t)
    parents = t.documents.select(F.col("doc_id").alias("child_id"), (F.col("doc_id") - F.col("doc_id") % 5).alias("parent"))
    return rounded(X.from_parents(of.run, parents, lambda pairs: X.overlap(X.Weighed(of.idx, of.terms, pairs))), "overlap")


_RM3 = f"""fb AS (SELECT query_id, word, s / greatest(sum(s) OVER (PARTITION BY query_id), 1e-9::DOUBLE) AS p FROM (SELECT query_id, word, idf * {NORM} AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(idf * {NORM}, 9) DESC, word) AS r
 FROM run JOIN post USING (doc_id) JOIN voc USING (word), stats WHERE (query_id, rank) IN (SELECT query_id, max(rank) FROM run WHERE rank <= 5 GROUP BY ALL)) WHERE r <= 10),
"""


@query("""SELECT query_id, doc_id, round(0.3::DOUBLE * s / idf_sum + 0.7::DOUBLE * coalesce(rm1, 0), 6) AS rm3 FROM run JOIN bm USING (query_id, doc_id) JOIN qi USING (query_id)
 LEFT JOIN (SELECT query_id, doc_id, sum(p) AS rm1 FROM run JOIN post USING (doc_id) JOIN fb USING (query_id, word) GROUP BY ALL) USING (query_id, doc_id)""", RUN + WT + _RM3)
def x5_rm3_score(t):
    return rounded(X.rm3_score(weighed(t), 5, 10, 0.3), "rm3")


@query("""SELECT query_id, doc_id, round(up / sqrt(d2 * q2), 6) AS dot FROM (SELECT query_id, doc_id, sum(qtf * tf * idf * idf) AS up FROM m JOIN run USING (query_id, doc_id) GROUP BY ALL)
 JOIN (SELECT doc_id, sum(tf * tf * idf * idf) AS d2 FROM post JOIN voc USING (word) GROUP BY ALL) USING (doc_id) JOIN qi USING (query_id)""", RUN + WT)
def f10_cosine_inner_product(t):
    of = weighed(t)
    q, d = X.cosine_vectors(of.idx, of.terms)
    x = q.select(F.col("id").alias("query_id"), "dim", F.col("val").alias("_q")).join(d.select(F.col("id").alias("doc_id"), "dim", "val"), "dim").join(of.pairs, ["query_id", "doc_id"], "left_semi")
    return rounded(x.groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("val")).alias("dot")), "dot")


@query("SELECT (SELECT count(*) FROM run) AS pairs, 0 AS faults", RUN)
def v5_consistent_export(t):
    """The cosine feature and the product of exported vectors agree on every pair."""
    of = weighed(t)
    q, d = X.cosine_vectors(of.idx, of.terms)
    x = q.select(F.col("id").alias("query_id"), "dim", F.col("val").alias("_q")).join(d.select(F.col("id").alias("doc_id"), "dim", "val"), "dim").join(of.pairs, ["query_id", "doc_id"], "left_semi")
    dots = x.groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("val")).alias("cosine"))
    faults = X.disagreements(X.cosine_tfidf(of), dots, "cosine")
    return of.pairs.agg(F.count("*").alias("pairs")).crossJoin(faults.agg(F.count("*").cast("int").alias("faults")))  # one row each


_WV = SOFT.split("sm AS")[0].replace("ascii(word) / 100.0::DOUBLE] AS v, idf", "ascii(word) / 100.0::DOUBLE] AS v")
_AVG = "SELECT {id}, [sum({n} * idf * v[1]) / count(*), sum({n} * idf * v[2]) / count(*), sum({n} * idf * v[3]) / count(*)] AS a FROM {rows} JOIN wv USING (word) JOIN voc USING (word) GROUP BY {id}"


@query("SELECT query_id, doc_id, round(coalesce(list_dot_product(q.a, d.a), 0), 6) AS embed FROM run LEFT JOIN (" + _AVG.format(id="query_id", n="qtf", rows="qt") + ") q USING (query_id) LEFT JOIN (" + _AVG.format(id="doc_id", n="tf", rows="post") + ") d USING (doc_id)", RUN + _WV)
def x7_embedding_dot(t):
    of = weighed(t)
    v = of.idx.vocab.join(of.terms.select("word").distinct(), "word", "left_semi").select("word", F.array(F.log1p(F.length("word")), 1.0 / (1 + F.col("df")), F.ascii("word") / 100.0).alias("v"))
    return rounded(X.embedding_dot(of, v, use_idf=True), "embed")


_TRUNC = """
tc AS (SELECT src, dst AS word FROM rs QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(p, 9) DESC, dst) <= 4),
rd AS (SELECT DISTINCT doc_id FROM run),
cd AS (SELECT DISTINCT doc_id, tc.word FROM rd JOIN post p USING (doc_id) JOIN tc ON tc.src = p.word),
ct AS (SELECT doc_id, dst AS word, sum(p * tf / greatest(doc_len, 1)) AS tr FROM rd JOIN post USING (doc_id) JOIN rs ON rs.src = post.word WHERE p >= 0.001::DOUBLE GROUP BY ALL),
cs AS (SELECT doc_id, word, ln(0.9::DOUBLE * coalesce(tr, 0) + 0.1::DOUBLE * c) - ln(0.1::DOUBLE * c) AS s FROM (SELECT doc_id, word, tr, greatest(1e-9::DOUBLE, coalesce(pc, 0)) AS c FROM cd LEFT JOIN ct USING (doc_id, word) LEFT JOIN (SELECT word, sum(tf) / (SELECT sum(tf) FROM post) AS pc FROM post GROUP BY word) USING (word))),
ck AS (SELECT doc_id, word, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, word) AS r FROM cs) JOIN (SELECT doc_id, count(*) AS n FROM post GROUP BY doc_id) USING (doc_id) WHERE r <= 2 * n),
"""


@query("""SELECT query_id, doc_id, round(coalesce(v, 0) / greatest(n, 1), 6) AS model1_top FROM run LEFT JOIN (SELECT query_id, doc_id, sum(qtf * s) AS v FROM run JOIN qt USING (query_id) JOIN ck USING (doc_id, word) GROUP BY ALL) USING (query_id, doc_id)
 JOIN (SELECT query_id, count(*) AS n FROM qt GROUP BY ALL) USING (query_id)""", RUN + BITEXT + RESCALED.replace("rs AS", "rs AS MATERIALIZED") + _TRUNC)
def m6_truncated_model1(t):
    of = weighed(t)
    table = M.rescaled(M.filtered(M.train(bitext(t), 2, 0.01), 0.01), 0.5)
    return rounded(M.truncated_score(of.pairs, of.idx.postings, of.terms, table, M.collection_probabilities(of.idx.postings), 4, 2), "model1_top")


@query("SELECT pair, array_to_string(src, ' ') AS src, array_to_string(dst[k * n + 1:k * n + n], ' ') AS dst FROM (SELECT *, greatest(floor(len(src) * 1.5::DOUBLE), 1)::BIGINT AS n FROM bi), range(0, 10000) r(k) WHERE k * n < len(dst)", BITEXT)
def m1_ratio_chunks(t):
    return M.by_ratio(bitext(t), 1.5).select("pair", F.array_join("src", " ").alias("src"), F.array_join("dst", " ").alias("dst"))


_SETTINGS = "gr AS (SELECT round(0.4::DOUBLE + 0.2::DOUBLE * i, 1) AS k1, round(0.3::DOUBLE + 0.1::DOUBLE * j, 1) AS b FROM range(7) x(i), range(8) y(j)),"


@query("SELECT query_id, k1, b, count(*) AS found, round(max(s), 5) AS best FROM (SELECT query_id, doc_id, k1, b, sum(qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avgdl))) AS s FROM m, stats, gr GROUP BY ALL) GROUP BY ALL", RUN + _SETTINGS)
def q21_bm25_settings(t):
    return X.bm25_grid(weighed(t), S.bm25_settings(t.spark)).withColumn("best", F.round("best", 5))


# --- model files, normalisers -----------------------------------------------------------


@query(SQL["r2_tree_model"])
def r2_tree_model_file(t):
    """A tree model, written to a file, loaded and scored."""
    path = shared_dir(t.spark, "model")
    models.save(t.spark, models.Model("LambdaMART", [TREES]), path)
    return feature_rows(t).select("query_id", "doc_id", models.load(t.spark, path).score().alias("score"))


@query("SELECT query_id, doc_id, CASE WHEN f1 > 30000 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN f2 > 0.05::DOUBLE THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN f1 > 60000 THEN 2.0::DOUBLE ELSE 0 END AS score FROM fe", FEATS)
def r2_threshold_model(t):
    m = models.parse("## RankBoost\n## Iteration = 3\n1:30000.0:0.5 2:0.05:0.25 1:60000.0:2.0\n")
    return feature_rows(t).select("query_id", "doc_id", m.score().alias("score"))


@query("SELECT query_id, doc_id, round(1.5::DOUBLE + 0.001::DOUBLE * f1 - 2.0::DOUBLE * f3, 6) AS score FROM fe", FEATS)
def r2_linear_model(t):
    m = models.parse("## Linear Regression\n## Lambda = 1.0E-10\n0:1.5 1:0.001 3:-2.0")
    return feature_rows(t).select("query_id", "doc_id", F.round(m.score(), 6).alias("score"))


@query("SELECT round(regr_slope(grade, f1) * 1000, 6) AS w1, round(regr_intercept(grade, f1), 6) AS w0, count(*) AS n FROM fe", FEATS)
def r12_trained_by_number(t):
    x = feature_rows(t).withColumn("feats", F.slice("feats", 1, 1))
    m = dict(models.train(9, x).body)
    return x.agg(F.round(F.lit(m[1] * 1000), 6).alias("w1"), F.round(F.lit(m[0]), 6).alias("w0"), F.count("*").alias("n"))


@query(None)
def r8_ada_rank(t):
    m = models.train("AdaRank", feature_rows(t), rounds=3, k=5)
    return t.spark.createDataFrame([(k, int(f), float(w)) for k, (f, w) in enumerate(m.body)], "round int, feature int, weight double")


@query(None)
def r9_rank_boost(t):
    m = models.train("RankBoost", feature_rows(t), rounds=4)
    return feature_rows(t).select("query_id", "doc_id", m.score().alias("score"))


@query(None)
def r10_list_net(t):
    from ranklode.operators import boosting

    w = boosting.neural(R.normalized(feature_rows(t), "linear"), "listnet", epochs=2, rate=0.1)
    return R.normalized(feature_rows(t), "linear").select("query_id", "doc_id", boosting.neural_score(w).alias("score"))


def _normal(k: int, of: str) -> str:
    return of.replace("?", f"f{k}")


@query("SELECT query_id, doc_id, [" + ", ".join(_normal(k, "round(CASE WHEN stddev_samp(?) OVER w > 0 THEN (? - avg(?) OVER w) / stddev_samp(?) OVER w ELSE ? END, 5) + 0.0::DOUBLE") for k in (1, 2, 3)) + "] AS feats FROM fe WINDOW w AS (PARTITION BY query_id)", FEATS)
def w7_standard_features(t):
    return R.normalized(feature_rows(t), "zscore").select("query_id", "doc_id", F.transform("feats", lambda x: F.round(x, 5) + 0.0).alias("feats"))


@query("SELECT query_id, doc_id, [" + ", ".join(_normal(k, "round(CASE WHEN max(?) OVER w > min(?) OVER w THEN (? - min(?) OVER w) / (max(?) OVER w - min(?) OVER w) ELSE 0 END, 6)") for k in (1, 2, 3)) + "] AS feats FROM fe WINDOW w AS (PARTITION BY query_id)", FEATS)
def w7_ranged_features(t):
    return R.normalized(feature_rows(t), "linear").select("query_id", "doc_id", F.transform("feats", lambda x: F.round(x, 6)).alias("feats"))


# --- samples, checks, converters --------------------------------------------------------

_POOL = """
sj AS (SELECT r.*, j.doc_id IS NOT NULL AS rel FROM run r LEFT JOIN qrels j USING (query_id, doc_id)), sa AS (SELECT *, max(rel::INT) OVER (PARTITION BY query_id) AS hit FROM sj),
sm AS (SELECT *, row_number() OVER (PARTITION BY query_id, NOT rel AND rank <= 8 ORDER BY md5('0:' || query_id || '/' || doc_id)) AS k FROM sa WHERE hit = 1),
"""


@query("SELECT query_id, doc_id, score, kind FROM (SELECT query_id, doc_id, score, CASE WHEN rel THEN 'positive' WHEN rank <= 2 THEN 'hard' WHEN rank <= 8 AND k <= 3 THEN 'medium' END AS kind FROM sm) WHERE kind IS NOT NULL", RUN + QRELS + _POOL)
def q9_scored_negatives(t):
    return S.scored_negatives(run(t), qrels(t), 2, 3, 8, 10)


@query("SELECT item_id AS query_id, doc_id, 4.0::DOUBLE AS grade FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text)))")
def q15_graded_answers(t):
    low = lambda x: F.lower(F.trim(x))
    items = t.benchmark.select(F.col("item_id").alias("query_id"), low("text").alias("text"))
    return C.containing(t.documents.select("doc_id", F.lower("text").alias("text")), items).withColumn("grade", F.lit(4.0))


_SETS = "bw AS (SELECT query_id, list_distinct(w) AS w FROM q), nr AS (SELECT a.query_id AS a_id, b.query_id AS b_id, len(list_intersect(a.w, b.w))::DOUBLE AS n, len(a.w) AS la, len(b.w) AS lb FROM bw a, bw b), near AS (SELECT a_id, b_id, n / (la + lb - n) AS jaccard FROM nr WHERE n / (la + lb - n) >= 0.2::DOUBLE),"


@query("SELECT a_id, b_id, round(jaccard, 6) AS jaccard FROM near", TERMS + _SETS)
def q18_near_queries(t):
    x = t.benchmark.select(F.col("item_id").alias("id"), "text")
    return rounded(S.token_overlap(x, x, 0.2), "jaccard")


@query("""SELECT a_id, b_id, a_doc, b_doc, round(n / (la + lb - n), 6) AS jaccard FROM (SELECT a_id, b_id, x.doc_id AS a_doc, y.doc_id AS b_doc, len(list_intersect(dx.w, dy.w))::DOUBLE AS n, len(dx.w) AS la, len(dy.w) AS lb
 FROM near JOIN qrels x ON x.query_id = a_id JOIN qrels y ON y.query_id = b_id JOIN dw dx ON dx.doc_id = x.doc_id JOIN dw dy ON dy.doc_id = y.doc_id)""", DOCS + TERMS + QRELS + _SETS + "dw AS (SELECT doc_id, list_distinct(w) AS w FROM d),")
def q18_leaked_answers(t):
    x, j = t.benchmark.select(F.col("item_id").alias("id"), "text"), qrels(t)
    return rounded(S.split_leaks(x, x, j, j, t.documents, 0.2)[1], "jaccard")


@query(f"SELECT unnest({list(S.LEAK_QUANTILES)}::DOUBLE[]) AS quantile, unnest(list_transform(quantile_cont(n_chars, {list(S.LEAK_QUANTILES)}), lambda x: round(x, 6))) AS value FROM documents")
def q18_quantile_report(t):
    return rounded(S.quantile_report(t.documents, "n_chars"), "value")


@query(f"""SELECT id, coalesce(any_value(e.note), any_value(s.note)) AS note FROM (SELECT doc_id AS id, text, list_sort(list_distinct({W("lower(text)")})) AS k FROM documents WHERE text IS NOT NULL) d
 LEFT JOIN (SELECT text, arg_min(quality, doc_id) AS note FROM documents JOIN labels USING (doc_id) GROUP BY text) e USING (text)
 LEFT JOIN (SELECT list_sort(list_distinct({W("lower(text)")})) AS k, arg_min(quality, doc_id) AS note FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY k) s USING (k)
 WHERE e.note IS NOT NULL OR s.note IS NOT NULL GROUP BY id""")
def j15_annotated_exact_first(t):
    """Documents with the quality of the first labelled one of the same text, or of the same words."""
    notes = t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("place"), "text", F.col("quality").alias("note"))
    return S.annotated(t.documents.select(F.col("doc_id").alias("id"), "text"), notes)


@query("SELECT count(*) AS n FROM pq WHERE abs(ndcg - ndcg_exp) > 0.0002::DOUBLE", L + LG + EVAL)
def e14_disagreeing_metrics(t):
    x = E.per_query(line_run(t), line_grades(t), 3)
    side = lambda c: x.select("query_id", F.lit(0).alias("doc_id"), F.col(c).alias("m"))
    return X.disagreements(side("ndcg"), side("ndcg_exp"), "m", 2e-4).agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS \"DOCNO\", array_to_string(" + W("lower(x)") + ", ' ') AS text, x AS text_raw FROM (SELECT doc_id, regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g') AS x FROM documents) WHERE x IS NOT NULL")
def q22_passages(t):
    lines = t.documents.filter("text is not null").select(F.concat_ws("\t", "doc_id", F.regexp_replace("text", "[\\t\\n\\r]+", " ")).alias("value"))
    return converters.passages(lines)


@query("SELECT 'orcas_' || l_orderkey AS query_id, l_partkey::VARCHAR AS doc_id, 1.0::DOUBLE AS grade FROM lineitem GROUP BY ALL")
def q22_clicks(t):
    lines = t.lineitem.select(F.concat_ws("\t", "l_orderkey", F.concat(F.lit("Order "), "l_orderkey"), "l_partkey", F.lit("http://x")).alias("value"))
    return converters.clicks(lines)[1]


@query("SELECT p_partkey::VARCHAR AS \"DOCNO\", array_to_string(" + W("lower(p_name)") + ", ' ') AS title, array_to_string(" + W("lower(p_name)") + ", ' ') || ' ' || array_to_string(" + W("lower(p_type)") + ", ' ') AS text, p_name || ' ' || p_type AS text_raw FROM part")
def q22_encyclopedia_passages(t):
    return converters.encyclopedia_passages(t.part.select(F.concat_ws("\t", "p_partkey", "p_type", "p_name").alias("value")))


@query("SELECT item_id || '-' || k AS \"DOCNO\", CASE k WHEN 0 THEN 'one' ELSE 'two' END AS text FROM benchmark, (VALUES (0), (1)) x(k)")
def q22_answers(t):
    record = F.concat(F.lit("<document><uri>"), "item_id", F.lit("</uri><subject>"), "text", F.lit("</subject><nbestanswers><answer_item>One</answer_item><answer_item>TWO</answer_item></nbestanswers></document>"))
    return converters.questions(t.benchmark.select(record.alias("value")))[1].select("DOCNO", "text")


# --- matches of words by vectors ---------------------------------------------------------

MATCH_SQL = SOFT.split("sm AS")[0] + """
mm AS (SELECT query_id, doc_id, pos, p.word, tf AS n, round(list_cosine_similarity(qv.v, dv.v), 9) AS sim FROM run JOIN qpos USING (query_id) JOIN wv qv USING (word) JOIN post p USING (doc_id) JOIN wv dv ON dv.word = p.word),
"""


def match_vectors(t, of):
    """Vectors of the queries' words, made of what the table says of them."""
    v = of.idx.vocab.join(of.terms.select("word").distinct(), "word", "left_semi")
    return v.select("word", F.array(F.log1p(F.length("word")), 1.0 / (1 + F.col("df")), F.ascii("word") / 100.0).alias("v"))


def matched(t, of=None):
    of = of or weighed(t)
    return D.matches(of.pairs, query_tokens(t), of.postings, match_vectors(t, of), sim=lambda a, b: F.round(V.cosine(a, b), 9))


@query("SELECT query_id, doc_id, [" + ", ".join(f"round(k{k}, 4)" for k in range(11)) + "] AS kernels FROM (SELECT query_id, doc_id, " + ", ".join(f"sum(ln(k{k} + 1e-6::DOUBLE)) AS k{k}" for k in range(11))
 + " FROM (SELECT query_id, doc_id, pos, " + ", ".join(f"sum(n * exp(-0.5::DOUBLE * ((sim - ({c}::DOUBLE)) / {w}::DOUBLE) * ((sim - ({c}::DOUBLE)) / {w}::DOUBLE))) AS k{k}" for k, (c, w) in enumerate(zip(D.CENTRES, D.WIDTHS, strict=True)))
 + " FROM mm GROUP BY ALL) GROUP BY query_id, doc_id)", RUN + MATCH_SQL)
def x14_kernel_pooling(t):
    return D.kernels(matched(t)).select("query_id", "doc_id", F.transform("kernels", lambda x: F.round(x, 4) + 0.0).alias("kernels"))


@query("SELECT query_id, doc_id, pos, [" + ", ".join(f"round(ln(sum(CASE WHEN b = {k} THEN n ELSE 0 END) + 1e-5::DOUBLE), 6)" for k in range(11)) + "] AS histogram FROM (SELECT *, least(floor((sim + 1.000001::DOUBLE) / 2.0::DOUBLE * 10), 10)::INT AS b FROM mm) GROUP BY query_id, doc_id, pos", RUN + MATCH_SQL)
def x14_match_histograms(t):
    return D.histograms(matched(t)).select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.transform("histogram", lambda x: F.round(x, 6)).alias("histogram"))


@query("""SELECT query_id, doc_id, pos, list_concat(list(sim ORDER BY sim DESC, word, i)[1:4], [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE])[1:4] AS best FROM (SELECT query_id, doc_id, pos, word, sim, unnest(range(least(n, 4)::BIGINT)) AS i FROM mm) GROUP BY query_id, doc_id, pos""", RUN + MATCH_SQL)
def x14_best_matches(t):
    return D.best_matches(matched(t), 4).select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"), "best")


_LEXICAL = "(tf / 2.0::DOUBLE) / (tf / 2.0::DOUBLE + greatest(0.0::DOUBLE, 0.75::DOUBLE * doc_len / 100.0::DOUBLE + 0.25::DOUBLE) + 1e-6::DOUBLE) * idf"


@query(f"SELECT query_id, doc_id, round(sum(qtf * {_LEXICAL}), 6) AS lexical FROM m SEMI JOIN run USING (query_id, doc_id) GROUP BY ALL", RUN)
def x15_lexical_weight(t):
    return rounded(D.lexical(weighed(t).matches(), tf_scale=2.0, length_scale=100.0, weight=0.75, bias=0.25), "lexical")


@query(f"SELECT query_id, doc_id, round(sum(0.1::DOUBLE + 0.7::DOUBLE * (best - 0.5::DOUBLE) / sqrt(0.04::DOUBLE + 1e-5::DOUBLE) + 0.3::DOUBLE * (lex - 2.0::DOUBLE) / sqrt(4.0::DOUBLE + 1e-5::DOUBLE)), 6) AS fused FROM (SELECT query_id, doc_id, word, {_LEXICAL} AS lex FROM m SEMI JOIN run USING (query_id, doc_id)) JOIN (SELECT query_id, doc_id, q.word, max(sim) AS best FROM mm JOIN qpos q USING (query_id, pos) GROUP BY ALL) USING (query_id, doc_id, word) GROUP BY query_id, doc_id", RUN + MATCH_SQL)
def x15_fused_terms(t):
    """Each common word's lexical weight and its best match, fused by given parameters."""
    of = weighed(t)
    lex = of.matches().select("query_id", "doc_id", "word", D.lexical_weight("tf", "doc_len", "idf", 2.0, 100.0, 0.75, 0.25).alias("lex"))
    near = matched(t, of).drop("word").join(query_tokens(t), ["query_id", "pos"]).groupBy("query_id", "doc_id", "word").agg(F.max("sim").alias("best"))
    return rounded(D.fused(lex.join(near, ["query_id", "doc_id", "word"]), ["best", "lex"], [0.5, 2.0], [0.04, 4.0], [0.7, 0.3], 0.1), "fused")


@query("""SELECT query_id, doc_id, sample, list(word ORDER BY pos) AS dst FROM (SELECT query_id, doc_id, sample, pos, arg_min(word, -ln(greatest(u, 2.0::DOUBLE ** -33)) / w) AS word FROM
 (SELECT *, ('0x' || substr(md5('0:' || query_id || '/' || doc_id || '/' || pos || '/' || sample || '/' || word), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM
  (SELECT query_id, doc_id, pos, p.word, sqrt((1 + (1 - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(qv.v, dv.v))))) * tf) AS w, unnest(range(2))::INT AS sample FROM qrels JOIN qpos USING (query_id) JOIN wv qv USING (word) JOIN post p USING (doc_id) JOIN wv dv ON dv.word = p.word))
 GROUP BY query_id, doc_id, sample, pos) GROUP BY query_id, doc_id, sample""", RUN + QRELS + SOFT.split("sm AS")[0])
def m1_sampled_bitext(t):
    """For each word of an item, a word of the document that holds it, drawn by distance and count."""
    of, held = weighed(t), qrels(t)
    docs = I.Index(of.idx.docs.join(bounded(held.select("doc_id").distinct()), "doc_id", "left_semi")).postings
    return M.sampled(held, query_tokens(t), docs, match_vectors(t, of), 2).select("query_id", "doc_id", "sample", "dst")
