"""Remaining operators: exports, filters, joins of annotations, samplers, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.functions import vectors as V
from ranklode.operators import candidates as C
from ranklode.operators import features as X
from ranklode.operators import index as I
from ranklode.operators import ltr as R
from ranklode.operators import passes as P
from ranklode.operators import sampling as S
from ranklode.operators import stages as G
from ranklode.operators import tranmodel as M
from ranklode.plans.learning import FEATS, TREES, feature_rows
from ranklode.plans.preparation import BITEXT, RESCALED, W, bitext
from ranklode.plans.registry import query
from ranklode.plans.retrieval import DOCS, NORM, QRELS, RUN, TERMS, WT, index, opened, qrels, query_tokens, rounded, run, terms
from ranklode.session import bounded

# --- text and fields --------------------------------------------------------------------


@query(f"SELECT doc_id, (coalesce(list_position(list_transform({W('text')}, lambda x: lower(x)), 'the'), 0) - 1)::BIGINT AS at FROM documents")
def t3_index_no_case(t):
    return t.documents.select("doc_id", T.index_no_case("THE", T.words("text")).alias("at"))


@query("SELECT event_id, CASE WHEN tag IN ('JJ', 'JJR', 'JJS', 'jj', 'jjr', 'jjs') THEN 'A' WHEN tag IN ('NN', 'NNS', 'NNP', 'NNPS', 'nn', 'nns', 'nnp', 'nnps') THEN 'N' WHEN tag IN ('RB', 'RBR', 'RBS', 'rb', 'rbr', 'rbs') THEN 'R' WHEN tag IN ('VB', 'VBD', 'VBG', 'VBN', 'VBP', 'VBZ', 'vb', 'vbd', 'vbg', 'vbn', 'vbp', 'vbz') THEN 'V' END AS kind FROM (SELECT event_id, ['JJR', 'nns', 'RB', 'VBZ', 'DT', 'NNX', 'vbd', 'Rbs'][event_id % 8 + 1] AS tag FROM events)")
def t20_pos_class(t):
    tag = F.element_at(F.array(*map(F.lit, ("JJR", "nns", "RB", "VBZ", "DT", "NNX", "vbd", "Rbs"))), (F.col("event_id") % 8 + 1).cast("int"))
    return t.events.select("event_id", T.pos_class(tag).alias("kind"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def t23_json_attribute(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, sentence, (unnest_at - 1)::INT AS at FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS unnest_at FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents))")
def t13_sentences(t):
    return t.documents.select("doc_id", F.posexplode(T.sentences("text")).alias("at", "sentence"))


@query("SELECT p_partkey AS docno, p_name AS title FROM part")
def p4_renamed(t):
    plan = [[("rename", {"mapping": {"p_partkey": "docno", "p_name": "title"}})]]
    return G.run(t.part, "p_partkey", plan).select("docno", "title")


@query("SELECT c_custkey, concat_ws(' ', coalesce(c_name, ''), coalesce(c_mktsegment, '')) AS text FROM customer")
def p5_concatenated(t):
    return G.run(t.customer, "c_custkey", [[("concat", {"fields": ["c_name", "c_mktsegment"], "output": "text"})]])


@query("SELECT word, count(*) AS n FROM (SELECT query_id, unnest(w) AS word FROM q) WHERE word IN (SELECT word FROM tok) GROUP BY word", DOCS + TERMS)
def p9_known_words(t):
    known = index(t).docs.select(F.explode("w").alias("word")).distinct()
    return query_tokens(t).join(known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT word FROM (SELECT DISTINCT word FROM tok) WHERE word IN (SELECT word FROM qt UNION SELECT lower(p_type) FROM part)", DOCS + TERMS)
def p10_vocabulary_union(t):
    either = terms(t).select("word").union(t.part.select(F.lower("p_type"))).distinct()
    return index(t).docs.select(F.explode("w").alias("word")).distinct().join(either, "word", "left_semi")


@query("SELECT src, dst, round(p, 6) AS p FROM t2 JOIN kw x ON x.word = src JOIN kw y ON y.word = dst WHERE p >= 0.05::DOUBLE", BITEXT + DOCS + "kw AS MATERIALIZED (SELECT DISTINCT word FROM tok),")
def p11_filtered_table(t):
    v = index(t).docs.select(F.explode("w").alias("word")).distinct()
    return rounded(M.filtered(M.train(bitext(t), 2, 0.05), 0.05, v), "p")


@query("SELECT word, df FROM voc WHERE word IN (SELECT word FROM qt)", DOCS + TERMS)
def p12_filtered_vocabulary(t):
    return index(t).vocab.join(terms(t).select("word").distinct(), "word", "left_semi").select("word", "df")


@query(f"SELECT doc_id, k::INT AS part, len(w[k * ((len(w) + parts - 1) // parts) + 1:(k + 1) * ((len(w) + parts - 1) // parts)])::INT AS n FROM (SELECT doc_id, {W('text')} AS w, (len({W('text')}) + 99) // 100 AS parts FROM documents), range(0, 100000) r(k) WHERE k < parts")
def w6_equal_batches(t):
    """Words in as few parts of at most 100 as go, all of about the same size."""
    x = t.documents.select("doc_id", T.words("text").alias("w")).withColumn("parts", F.ceil(F.size("w") / 100).cast("int")).filter("parts > 0")
    size = F.ceil(F.size("w") / F.col("parts")).cast("int")
    return x.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("doc_id", "part", F.size(F.slice("w", F.col("part") * size + 1, size)).alias("n"))


# --- joins ------------------------------------------------------------------------------


@query("SELECT query_id, doc_id, f AS retrieval FROM run JOIN (SELECT query_id, doc_id // 5 AS p, max(score) AS f FROM run GROUP BY ALL) x USING (query_id) WHERE x.p = doc_id // 5", RUN)
def j4_parent_features(t):
    r = run(t).withColumn("_p", F.floor(F.col("doc_id") / 5))
    f = r.groupBy("query_id", "_p").agg(F.max("score").alias("retrieval"))
    return r.join(f, ["query_id", "_p"]).select("query_id", "doc_id", "retrieval")


@query("SELECT o_orderkey, o_orderstatus, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def j8_merged_entries(t):
    """Entries of two files with the same keys; here keys without lines are left out first."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    both = t.orders.select("o_orderkey", "o_orderstatus").join(lines.select("o_orderkey"), "o_orderkey", "left_semi").join(lines, "o_orderkey", "full")
    return both.filter(F.col("o_orderstatus").isNotNull() & F.col("n").isNotNull())


@query("SELECT doc_id, min(first_id) AS first_id FROM (SELECT doc_id, list_sort(list_distinct(w)) AS s FROM d) JOIN (SELECT doc_id AS first_id, list_sort(list_distinct(w)) AS s FROM d SEMI JOIN labels USING (doc_id)) USING (s) GROUP BY doc_id", DOCS)
def j15_annotated(t):
    """Documents with the first labelled one of the same set of words."""
    notes = t.documents.join(t.labels, "doc_id", "left_semi").select(F.col("doc_id").alias("place"), F.array_join(F.sort_array(F.array_distinct(T.tokens("text"))), " ").alias("text"), F.col("doc_id").alias("note"))
    return S.annotated(t.documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), notes).select(F.col("id").alias("doc_id"), F.col("note").alias("first_id"))


@query("SELECT a.doc_id AS a_id, b.doc_id AS b_id FROM qrels a JOIN qrels b ON b.query_id = a.query_id + 1", QRELS)
def j16_relevant_pairs(t):
    a, b = qrels(t).select("query_id", F.col("doc_id").alias("a_id")), qrels(t).select((F.col("query_id") - 1).alias("query_id"), F.col("doc_id").alias("b_id"))
    return a.join(b, "query_id").select("a_id", "b_id")


# --- similarities -----------------------------------------------------------------------


@query(None)
def x4_sdm(t):
    of = X.Weighed(opened(t), terms(t))
    parts = X.sdm_parts(of.idx, of.terms, query_tokens(t), of.run)
    x = parts.join(t.benchmark.select(F.col("item_id").alias("query_id"), T.tokens("text").alias("qw")), "query_id").join(of.idx.docs.select("doc_id", "w"), "doc_id")
    return rounded(P.with_sdm(x), "unordered", "sdm")


@query(f"SELECT query_id, doc_id, round(sum(qtf * idf * {NORM}), 6) AS bm25 FROM m JOIN run USING (query_id, doc_id), stats GROUP BY ALL", RUN)
def f21_bm25_of_texts(t):
    """BM25 of query and document texts, the index giving idf and average length only."""
    of = X.Weighed(opened(t), terms(t))
    x = of.run.join(t.documents.select("doc_id", T.tokens("text").alias("w")), "doc_id").withColumn("doc_len", F.size("w").cast("double"))
    tf = x.select("query_id", "doc_id", "doc_len", F.explode("w").alias("word")).groupBy("query_id", "doc_id", "doc_len", "word").agg(F.count("*").cast("double").alias("tf"))
    s = tf.join(of.weights, ["query_id", "word"]).withColumn("avgdl", F.lit(of.idx.figures.avgdl))
    return rounded(s.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * C.norm_tf()).alias("bm25")), "bm25")


SOFT = """
wv AS (SELECT word, [ln(1.0::DOUBLE + len(word)), 1.0::DOUBLE / (1 + df), ascii(word) / 100.0::DOUBLE] AS v, idf FROM voc WHERE word IN (SELECT word FROM qt)),
sm AS (SELECT query_id, doc_id, qv.word, qtf, qv.idf, tf, doc_len, 0.5::DOUBLE * (1 + list_cosine_similarity(qv.v, dv.v)) AS sim FROM run JOIN qt USING (query_id) JOIN wv qv USING (word) JOIN post p USING (doc_id) JOIN (SELECT word, [ln(1.0::DOUBLE + len(word)), 1.0::DOUBLE / (1 + df), ascii(word) / 100.0::DOUBLE] AS v FROM voc) dv ON dv.word = p.word),
st AS (SELECT query_id, doc_id, word, qtf, idf, any_value(doc_len) AS doc_len, sum(CASE WHEN sim >= 0.999::DOUBLE THEN tf * sim ELSE 0 END) AS tf FROM sm GROUP BY ALL),
"""


@query(f"SELECT query_id, doc_id, round(sum(qtf * idf * {NORM}), 6) AS soft FROM st, stats GROUP BY query_id, doc_id", RUN + SOFT)
def f3_soft_bm25(t):
    """BM25 in which a document's words, whether a query has them or not, count for near query words, by similarity."""
    of = X.Weighed(opened(t), terms(t))
    idx, r, q = of.idx, of.run, of.terms
    v = idx.vocab.select("word", "idf", F.log1p(F.length("word")).alias("v1"), (1.0 / (1 + F.col("df"))).alias("v2"), (F.ascii("word") / 100.0).alias("v3"))
    dot = lambda a, b: 0.0 + F.col(f"{a}1") * F.col(f"{b}1") + F.col(f"{a}2") * F.col(f"{b}2") + F.col(f"{a}3") * F.col(f"{b}3")
    v = v.withColumn("vn", F.sqrt(dot("v", "v")))
    qs = r.select("query_id", "doc_id").join(q, "query_id").join(v, "word")
    few = idx.docs.join(bounded(r.select("doc_id").distinct()), "doc_id", "left_semi")
    ds = few.select("doc_id", "doc_len", F.explode("w").alias("word")).groupBy("doc_id", "doc_len", "word").agg(F.count("*").cast("double").alias("tf"))
    ds = ds.join(v.drop("idf").withColumnsRenamed({f"v{n}": f"d{n}" for n in "123n"}), "word").drop("word")
    sim = 0.5 * (1 + dot("v", "d") / (F.col("vn") * F.col("dn")))
    x = qs.join(ds, "doc_id").withColumn("_s", F.when(sim >= 0.999, F.col("tf") * sim).otherwise(0.0))
    x = x.groupBy("query_id", "doc_id", "word", "qtf", "idf").agg(F.first("doc_len").alias("doc_len"), F.sum("_s").alias("tf")).withColumn("avgdl", F.lit(idx.figures.avgdl))
    return rounded(x.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * C.norm_tf()).alias("soft")), "soft")


@query("SELECT query_id, doc_id, round(sum(q.val * d.val), 6) AS dot FROM (SELECT o_custkey AS query_id, o_orderkey % 100 AS dim, max(o_totalprice) AS val FROM orders WHERE o_custkey % 50 = 0 GROUP BY ALL) q JOIN (SELECT l_suppkey AS doc_id, l_partkey % 100 AS dim, max(l_quantity) AS val FROM lineitem GROUP BY ALL) d USING (dim) GROUP BY ALL")
def x9_sparse_embeddings(t):
    q = t.orders.filter("o_custkey % 50 = 0").groupBy(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 100).alias("dim")).agg(F.max("o_totalprice").alias("val"))
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 100).alias("dim")).agg(F.max("l_quantity").alias("val"))
    return rounded(V.sparse_products(q, d).select(F.col("a_id").alias("query_id"), F.col("b_id").alias("doc_id"), "dot"), "dot")


# --- translation model ------------------------------------------------------------------


@query("SELECT pair, array_to_string(src, ' ') AS src, array_to_string(dst[k * 5 + 1:k * 5 + 5], ' ') AS dst FROM bi, range(0, 10000) r(k) WHERE k * 5 < len(dst)", BITEXT)
def m1_bitext_chunks(t):
    return M.chunked(bitext(t), 5).select("pair", F.array_join("src", " ").alias("src"), F.array_join("dst", " ").alias("dst"))


@query("SELECT src, dst, round(p, 6) AS p FROM rs WHERE p >= 0.1::DOUBLE AND src IN (SELECT word FROM qt)", TERMS + BITEXT + RESCALED)
def m8_associations(t):
    table = M.rescaled(M.filtered(M.train(bitext(t), 2, 0.01), 0.01), 0.5)
    return rounded(M.associations(table, terms(t), 0.1), "p")


@query("SELECT a AS src, b AS dst, round(greatest(coalesce(p, 0), CASE WHEN a = b THEN 0.05::DOUBLE ELSE 0 END), 6) AS p FROM (SELECT DISTINCT x.word AS a, y.word AS b FROM qt x JOIN qt y ON y.query_id = x.query_id + 1) LEFT JOIN rs ON src = a AND dst = b", TERMS + BITEXT + RESCALED)
def m4b_lookup(t):
    """Pairs of each item's words with the next item's."""
    q = terms(t)
    pairs = q.select("query_id", F.col("word").alias("src")).join(q.select((F.col("query_id") - 1).alias("query_id"), F.col("word").alias("dst")), "query_id").select("src", "dst").distinct()
    return rounded(M.looked_up(pairs, M.rescaled(M.filtered(M.train(bitext(t), 2, 0.01), 0.01), 0.5), 0.05).select("src", "dst", "p"), "p")


# --- samplers and exports ---------------------------------------------------------------


@query("SELECT doc_id, positive FROM (SELECT doc_id, true AS positive FROM (SELECT DISTINCT doc_id FROM qrels) UNION ALL SELECT doc_id, false FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels) ORDER BY md5('0:' || doc_id), doc_id LIMIT (SELECT count(DISTINCT doc_id) FROM qrels)))", QRELS)
def q7_balanced_sample(t):
    pos = qrels(t).select("doc_id").distinct()
    neg = S.sample(t.documents.select("doc_id").join(pos, "doc_id", "left_anti"), "doc_id", pos.count())
    return pos.withColumn("positive", F.lit(True)).unionByName(neg.withColumn("positive", F.lit(False)))


@query("""SELECT query_id, p.doc_id AS pos_id, n.doc_id AS neg_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('0:' || query_id || '/' || doc_id)) AS r FROM qrels) p
 JOIN (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('0:' || query_id || '/' || doc_id)) AS r FROM run WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM qrels)) n USING (query_id, r)""", RUN + QRELS)
def q13_unique_sampler(t):
    """Positives paired with negatives, none twice."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(S.order_key(F.concat_ws("/", "query_id", "doc_id"))))
    pos = qrels(t).select("query_id", F.col("doc_id").alias("pos_id"), r.alias("_r"))
    neg = run(t).join(qrels(t), ["query_id", "doc_id"], "left_anti").select("query_id", F.col("doc_id").alias("neg_id"), r.alias("_r"))
    return pos.join(neg, ["query_id", "_r"]).drop("_r")


@query("""SELECT b.text AS anchor, p.text AS positive, n.text AS negative FROM (SELECT query_id, doc_id FROM qrels) j JOIN (SELECT query_id, doc_id AS neg FROM run WHERE rank <= 2 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM qrels)) USING (query_id)
 JOIN benchmark b ON b.item_id = query_id JOIN documents p ON p.doc_id = j.doc_id JOIN documents n ON n.doc_id = neg""", RUN + QRELS)
def k14_triplets(t):
    neg = run(t).filter("rank <= 2").join(qrels(t), ["query_id", "doc_id"], "left_anti").select("query_id", F.col("doc_id").alias("neg"))
    x = qrels(t).select("query_id", "doc_id").join(neg, "query_id")
    text = lambda df, id_, to, as_: df.select(F.col(id_).alias(to), F.col("text").alias(as_))
    x = x.join(text(t.benchmark, "item_id", "query_id", "anchor"), "query_id").join(text(t.documents, "doc_id", "doc_id", "positive"), "doc_id").join(text(t.documents, "doc_id", "neg", "negative"), "neg")
    return x.select("anchor", "positive", "negative")


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id) WHERE text IN (SELECT text FROM documents ANTI JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def q19_exact_overlap(t):
    """Labelled documents whose text an unlabelled one has."""
    other = t.documents.join(t.labels, "doc_id", "left_anti").select("text").distinct()
    return t.documents.join(t.labels, "doc_id", "left_semi").join(other, "text", "left_semi").select("doc_id")


@query(f"SELECT doc_id::VARCHAR AS \"DOCNO\", array_to_string({W('lower(text)')}, ' ') AS text, substring(text, 1, 2000) AS text_raw FROM documents")
def q22_converted_documents(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("DOCNO"), F.array_join(T.tokens("text"), " ").alias("text"), T.truncate_chars("text", 2000).alias("text_raw"))


@query("SELECT part, count(*) AS n FROM (SELECT 'set_0:' || item_id AS part FROM benchmark UNION ALL SELECT 'set_1:' || doc_id FROM labels) GROUP BY part")
def u6_concatenated_sets(t):
    x = t.benchmark.select(F.concat(F.lit("set_0:"), "item_id").alias("part")).union(t.labels.select(F.concat(F.lit("set_1:"), "doc_id")))
    return x.groupBy("part").agg(F.count("*").alias("n"))


# --- statistics -------------------------------------------------------------------------


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY event_type")
def a7_mean_deviation(t):
    return rounded(t.events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev("value").alias("deviation")), "mean", "deviation")


@query("SELECT count(*) AS pairs, round(avg(len(src)), 6) AS src, round(avg(len(dst)), 6) AS dst FROM bi", BITEXT)
def a10_bitext_statistics(t):
    return rounded(bitext(t).agg(F.count("*").alias("pairs"), F.avg(F.size("src")).alias("src"), F.avg(F.size("dst")).alias("dst")), "src", "dst")


@query("SELECT count(*) AS n, count(DISTINCT conv_id) AS keys FROM conversations")
def a13_annotated_points(t):
    return t.conversations.agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("keys"))


@query("SELECT feature, n FROM (VALUES (1, 1), (2, 1), (3, 1)) x(feature, n)")
def a14_feature_use(t):
    return t.spark.createDataFrame(sorted(R.feature_use([TREES]).items()), "feature int, n int")


@query("SELECT feature::INT AS feature, count(x) AS n, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(sqrt(var_samp(x)), 4) AS deviation FROM (SELECT unnest([1, 2, 3]) AS feature, unnest([f1, f2, f3]) AS x FROM fe) GROUP BY feature", FEATS)
def a14_feature_statistics(t):
    x = rounded(R.feature_statistics(feature_rows(t)), "mean", "median")
    return x.withColumn("deviation", F.round(F.sqrt("variance"), 4)).drop("variance")


@query("SELECT query_id, round(idf_sum, 6) AS idf_sum FROM qi", DOCS + TERMS + WT)
def f2_query_normaliser(t):
    return rounded(X.known_idf(index(t), terms(t)), "idf_sum")
