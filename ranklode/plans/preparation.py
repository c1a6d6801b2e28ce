"""Data preparation queries: text functions, projections, joins, set operations, samples,
translation model. Conversations give the bitext: a user's turn and the answer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklode.functions import html as H
from ranklode.functions import text as T
from ranklode.operators import features as X
from ranklode.operators import index as I
from ranklode.operators import sampling as S
from ranklode.operators import tranmodel as M
from ranklode.plans.registry import Tables, query
from ranklode.plans.retrieval import DOCS, LG, L, QRELS, RUN, index, line_grades, line_run, opened, qrels, rounded, run, terms

B = r"'[ \t\n\r\f]+'"


def W(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {B}), lambda x: x <> '')"


# --- scalar text functions --------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({W('text')}, ' ') AS text FROM documents")
def t2_normalized_space(t):
    return t.documents.select("doc_id", T.normalize_space("text").alias("text"))


@query(r"SELECT doc_id, len(regexp_split_to_array(text, '[ \t\n\r\f]'))::INT AS n FROM documents")
def t1_single_blanks(t):
    return t.documents.select("doc_id", F.size(T.split_single_blanks("text")).alias("n"))


@query(r"SELECT doc_id, regexp_replace(text, '[!-/:-@\[-`{-~]+', ' ', 'g') AS text FROM documents")
def t5_no_punctuation(t):
    return t.documents.select("doc_id", T.remove_punct("text").alias("text"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r', '', 'g'), '[\x{2018}\x{2019}]', '''', 'g'), '[^\x00-\x7F]', ' ', 'g'),
 '([?!.:])[?!.:]+', '\1', 'g'), '(?i)<br */?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '\n+', chr(10), 'g') AS text FROM pages""")
def t6_clean_up(t):
    return t.pages.select("page_id", T.clean_up("html").alias("text"))


@query(r"SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS non_ascii, length(regexp_replace(text, '[^\x{20}-\x{FC}\t\n\r]', '', 'g'))::INT AS n FROM documents")
def t7_non_ascii(t):
    return t.documents.select("doc_id", T.has_non_ascii("text").alias("non_ascii"), F.length(T.remove_bad_unicode("text")).alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter({W("translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")}, lambda x: x NOT IN ('OR', 'AND', 'NOT', 'TO')), ' ') AS text FROM documents")
def t8_no_operators(t):
    return t.documents.select("doc_id", T.remove_operators(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("text"))


@query(r"SELECT page_id, regexp_replace(html, '</?[a-zA-Z]+/?>', ' ', 'g') AS text FROM pages")
def t9_plain_tags(t):
    return t.pages.select("page_id", T.remove_plain_tags("html").alias("text"))


@query(f"SELECT doc_id, len(list_filter({W('text')}, lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}_.\\-]+$')))::INT AS n FROM documents")
def t10_alphanumeric_words(t):
    return t.documents.select("doc_id", F.size(F.filter(T.words("text"), lambda x: T.is_alpha_num(x))).alias("n"))


@query(None)
def t14_url_words(t):
    """Without SQL: that can't decode what urls escape; the tests do it by hand."""
    return t.pages.select("page_id", T.pretokenize_url("url").alias("words"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z]+://)[^/@]*@', '\1'), '^([a-zA-Z]+://[^/]+)/$', '\1') AS url FROM pages")
def t18_normalized_url(t):
    return t.pages.select("page_id", T.normalize_url("url").alias("url"))


def entities(x: str) -> str:
    """SQL: the references that pages have, decoded; the last letters of a page may be cut off."""
    for name, value in (("copy", "chr(169)"), ("middot", "chr(183)"), ("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("amp", "'&'")):
        x = f"regexp_replace({x}, '&{name};?', {value}, 'g')"
    return x


#: Without the tag that a page which is cut off ends with.
WHOLE = "regexp_replace(html, '<[a-zA-Z/!][^>]*$', '')"
LINK = '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)(?:</a>|$)'


@query(f"""SELECT page_id, trim({entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)(?:</title>|$)', 1)")}) AS title,
 len(regexp_extract_all({WHOLE}, '{LINK}', 1))::INT AS links FROM pages""")
def t16_html_title_links(t):
    return t.pages.select("page_id", H.page("html").alias("p")).select("page_id", "p.title", F.size("p.links").alias("links"))


TAGLESS = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({WHOLE}, '(?is)<(script|style)[^>]*>.*?(</(script|style)>|$)', ' ', 'g'), '(?s)<!--.*?(-->|$)', ' ', 'g'), '(?is)<title[^>]*>.*?(</title>|$)', ' ', 'g'),
 '(?i)</?(p|div|br|li|ul|ol|h[1-6]|table|tr|td|article|nav|section|footer|main|header)(\\s[^>]*)?>', chr(10), 'g'), '<[a-zA-Z/!][^>]*>', '', 'g')"""
TEXT = f"trim(regexp_replace(regexp_replace({entities(TAGLESS)}, '[ \\t\\x{{A0}}]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ')".replace("\\\\", "\\")


@query(f"SELECT page_id, {TEXT} AS text FROM pages")
def t16_html_text(t):
    return t.pages.select("page_id", T.strip_html("html").alias("text"))


@query(f"SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, {entities('unnest(regexp_extract_all(' + WHOLE + ', ' + repr(LINK) + ', 1))')} AS href FROM pages) GROUP BY href")
def t19_link_targets(t):
    links = t.pages.select("page_id", F.explode(T.html_links("html")).alias("a"))
    return links.groupBy(F.col("a.href").alias("href")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(f"SELECT page_id, host || href AS target, count(*) AS n FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, {entities('unnest(regexp_extract_all(' + WHOLE + ', ' + repr(LINK) + ', 1))')} AS href FROM pages) GROUP BY ALL")
def t18_resolved_links(t):
    """Where the links of a page lead: relative ones by the page's own URL, or its base's."""
    x = t.pages.select("page_id", "url", H.page("html").alias("p")).select("page_id", F.coalesce(T.resolved_url("p.base", "url"), "url").alias("at"), F.explode("p.links").alias("a"))
    return x.groupBy("page_id", T.resolved_url("a.href", "at").alias("target")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://(www\.)?', '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM pages".replace("\\\\", "\\"))
def t18_url_words(t):
    return t.pages.select("page_id", T.url_words("url").alias("words"))


@query(f"SELECT doc_id, array_to_string({W('text')}[1:20], ' ') AS head, substring(text, 1, 100) AS chars FROM documents")
def p16_truncated(t):
    return t.documents.select("doc_id", T.truncate_words("text", 20).alias("head"), T.truncate_chars("text", 100).alias("chars"))


@query(f"SELECT doc_id, array_to_string(list_filter({W('text')}, lambda x: lower(x) NOT IN ('and', 'of', 'the')), ' ') AS text FROM documents")
def p15_words_removed(t):
    return t.documents.select("doc_id", T.remove_words("text", ["the", "of", "and"]).alias("text"))


# --- projections and filters ------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents")
def p1_kept_fields(t):
    return t.documents.select("doc_id", "lang", "source")


@query("SELECT trim(p_name) AS value FROM part WHERE trim(p_name) <> ''")
def p2_field_values(t):
    return t.part.select(F.trim("p_name").alias("value")).filter("value <> ''")


@query("SELECT p_partkey AS docno, p_name || ' ' || coalesce(p_type, '') AS text FROM part")
def p6_staged_pipeline(t):
    """Copy, then rename, then concatenate: one projection after another, fused by the planner."""
    copied = t.part.select("p_partkey", "p_name", "p_type")
    renamed = copied.select(F.col("p_partkey").alias("docno"), F.col("p_name").alias("title"), F.col("p_type").alias("body"))
    return renamed.select("docno", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"))


@query(f"SELECT item_id, len(list_filter({W('lower(text)')}, lambda x: x NOT IN ('the', 'of', 'and')))::INT AS n FROM benchmark WHERE len(list_filter({W('lower(text)')}, lambda x: x NOT IN ('the', 'of', 'and'))) >= 30")
def p13_long_queries(t):
    n = F.size(T.words(T.remove_words(F.lower("text"), ["the", "of", "and"])))
    return t.benchmark.select("item_id", n.alias("n")).filter("n >= 30")


@query(f"SELECT avg(coalesce(len({W('text')}), 0)) AS tokens FROM documents")
def a8_tokens_per_entry(t):
    return t.documents.agg(F.avg(F.coalesce(F.size(T.words("text")), F.lit(0))).alias("tokens"))


@query("SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, round(avg(n_chars), 6) AS chars FROM documents GROUP BY lang")
def a9_collection_statistics(t):
    return rounded(t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.avg("n_chars").alias("chars")), "chars")


@query("SELECT round(quantile_cont(n_chars, 0.1), 6) AS q10, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.9), 6) AS q90, max(n_chars) AS top FROM documents")
def a11_quantiles(t):
    q = S.quantiles(t.documents, "n_chars", (0.1, 0.5, 0.9))
    each = [F.max(F.when(F.col("quantile") == x, F.col("value"))).alias(f"q{int(100 * x)}") for x in (0.1, 0.5, 0.9)]
    return rounded(q.agg(*each).crossJoin(t.documents.agg(F.max("n_chars").alias("top"))), "q10", "q50", "q90")


@query("SELECT lang, arg_max(doc_id, n_chars * 1000000 + doc_id) AS best FROM documents GROUP BY lang")
def a12_best_of_group(t):
    return t.documents.groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("best"))


@query(
    f"""SELECT doc_id, k::INT AS k, array_to_string(w[k * 50 + 1:k * 50 + 100], ' ') AS piece FROM (SELECT doc_id, {W('text')} AS w FROM documents), range(0, 100000) r(k)
 WHERE len(w) > 0 AND k < ceil(greatest(len(w) - 100, 0) / 50.0) + 1"""
)
def w5_sliding_windows(t):
    """Windows of 100 words, every 50."""
    n = (F.ceil(F.greatest(F.size("w") - 100, F.lit(0)) / 50) + 1).cast("int")
    x = t.documents.select("doc_id", T.words("text").alias("w")).filter(F.size("w") > 0)
    return x.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).select("doc_id", "k", F.array_join(F.slice("w", F.col("k") * 50 + 1, F.lit(100)), " ").alias("piece"))


@query("""SELECT query_id, doc_id, round(score / sum(abs(score)) OVER w, 6) AS by_sum, round(coalesce((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), score), 6) AS z,
 round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) AS by_range FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM lr) WINDOW w AS (PARTITION BY query_id)""", L)
def w7_normalized_scores(t):
    w = Window.partitionBy("query_id")
    s, sd = F.col("score"), F.stddev_samp("score").over(w)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    x = line_run(t).select("query_id", "doc_id", (s / F.sum(F.abs(s)).over(w)).alias("by_sum"), F.when(sd > 0, (s - F.avg(s).over(w)) / sd).otherwise(s).alias("z"), F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(0.0).alias("by_range"))
    return rounded(x, "by_sum", "z", "by_range")


# --- joins and set operations -----------------------------------------------------------


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j7_joined_entries(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality", "toxic"), "doc_id")


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def j10_grouped_texts(t):
    x = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return x.select("conv_id", F.array_join(F.col("_t.text"), " ").alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM qrels WHERE grade > 0) OR ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2", QRELS)
def j11_judged_or_sampled(t):
    return S.judged_or_sampled(t.documents.select("doc_id"), qrels(t), 0.2, "7")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)")
def j12_unseen_queries(t):
    return t.benchmark.join(t.documents.select("text").distinct(), "text", "left_anti").select("item_id")


@query("SELECT query_id, doc_id, contains(lower(d.text), lower(trim(b.text))) AS hit FROM run JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id", RUN)
def j13_contained_answers(t):
    x = run(t).join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("answer")), "query_id")
    return x.select("query_id", "doc_id", F.contains(F.lower("text"), F.lower(F.trim("answer"))).alias("hit"))


@query("""SELECT a.id AS a_id, b.id AS b_id, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM
 (SELECT item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w FROM benchmark) a, (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w FROM documents) b
 WHERE len(list_intersect(a.w, b.w)) >= 0.1::DOUBLE * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AND len(a.w) > 0 AND len(b.w) > 0""".replace("\\\\", "\\"))
def j14_token_overlap(t):
    a, b = t.benchmark.select(F.col("item_id").alias("id"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text")
    return rounded(S.token_overlap(a, b, 0.1), "jaccard")


@query("SELECT doc_id, 'labelled' AS part FROM labels UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u2_mixed_sets(t):
    a = t.labels.select("doc_id", F.lit("labelled").alias("part"))
    return a.unionByName(t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("part")))


@query("SELECT * FROM (SELECT doc_id, 'extra' AS fault FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels))")
def u3_split_faults(t):
    return S.split_faults(t.labels.select("doc_id"), [t.documents.select("doc_id")])


@query("SELECT DISTINCT p_name AS word FROM part UNION SELECT p_type FROM part")
def u4_merged_words(t):
    return t.part.select(F.col("p_name").alias("word")).union(t.part.select("p_type")).distinct()


# --- samples ----------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 100")
def q1_sample(t):
    return S.sample(t.orders.select("o_orderkey"), "o_orderkey", 100, "3")


@query("""SELECT draw, p_partkey AS id FROM (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) AS hi, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS lo FROM part)
 JOIN (SELECT i AS draw, (('0x' || substr(md5('5:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (SELECT sum(p_size) FROM part)::DOUBLE AS u FROM range(50) r(i)) ON u >= lo AND u < hi""")
def q2_weighted_sample(t):
    return S.weighted_with_replacement(t.part, "p_partkey", "p_size", 50, "5")


@query("SELECT item_id, CASE WHEN r <= 10 THEN 'dev' WHEN r <= n - 5 THEN 'train' ELSE 'test' END AS part FROM (SELECT item_id, row_number() OVER (ORDER BY md5('0:' || item_id), item_id) AS r, count(*) OVER () AS n FROM benchmark)")
def q4_split_by_sizes(t):
    return S.split_by_sizes(t.benchmark.select("item_id"), "item_id", {"dev": 10, "train": None, "test": 5})


@query("SELECT doc_id, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.2::DOUBLE THEN 'dev' ELSE 'test' END AS part FROM (SELECT doc_id, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)")
def q5_split_by_chance(t):
    return S.split_by_chance(t.documents.select("doc_id"), "doc_id", {"train": 0.7, "dev": 0.2, "test": 0.1})


NEG = """
pos AS (SELECT query_id, doc_id FROM qrels WHERE grade > 0),
pool AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id DESC) AS r FROM run WHERE query_id IN (SELECT query_id FROM pos) AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM pos)),
rest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('0:' || query_id || '/' || doc_id)) AS m FROM pool WHERE r > 3),
"""


@query("SELECT query_id, doc_id, 'positive' AS kind FROM pos UNION ALL SELECT query_id, doc_id, 'hard' FROM pool WHERE r <= 3 UNION ALL SELECT query_id, doc_id, 'medium' FROM rest WHERE m <= 2", RUN + QRELS + NEG)
def q8_negatives(t):
    return S.training_pairs(run(t), qrels(t), t.documents, 3, 2, 0)


@query("SELECT query_id, doc_id, (rank - 1)::INT AS pos, (1 - rank)::DOUBLE AS score FROM run WHERE query_id IN (SELECT query_id FROM qrels WHERE grade > 0)", RUN + QRELS)
def q10_test_export(t):
    return S.test_export(run(t), qrels(t))


@query("SELECT query_id, doc_id, 1.0::DOUBLE AS grade FROM run WHERE rank <= 3", RUN)
def q14_pseudo_labels(t):
    return S.pseudo_labels(run(t), 3)


@query("SELECT query_id, 'too few results' AS fault FROM lr GROUP BY query_id HAVING count(*) < 3 UNION SELECT query_id, 'unknown document' FROM lr WHERE doc_id NOT IN (SELECT doc_id FROM documents)", L)
def q16_run_faults(t):
    return S.run_faults(line_run(t), t.documents, 3)


@query("""SELECT query_id, slot::INT AS slot, doc_id, positive FROM (
 SELECT query_id, 0 AS slot, doc_id, positive FROM cs WHERE positive AND r = 0 UNION ALL
 SELECT query_id, s + 1, doc_id, positive FROM cs, range(0, 4) x(s) WHERE NOT positive AND s % n = r)
 WHERE query_id IN (SELECT query_id FROM cs WHERE positive) AND query_id IN (SELECT query_id FROM cs WHERE NOT positive)""", L + """
cs AS (SELECT *, row_number() OVER (PARTITION BY query_id, positive ORDER BY md5('0:' || query_id || '/' || doc_id)) - 1 AS r, count(*) OVER (PARTITION BY query_id, positive) AS n FROM (SELECT query_id, doc_id, grade > 0 AS positive FROM lg)),""".replace("cs AS", LG + "cs AS"))
def q12_chunk_sampler(t):
    g = line_grades(t).select("query_id", "doc_id", (F.col("grade") > 0).alias("positive"))
    return S.chunk_sampler(g, 4)


@query("SELECT doc_id, query_id, k1, b FROM (SELECT DISTINCT doc_id, query_id FROM run WHERE rank <= 1), (VALUES (0.4::DOUBLE), (1.2::DOUBLE)) x(k1), (VALUES (0.3::DOUBLE), (0.75::DOUBLE)) y(b)", RUN)
def q21_parameter_grid(t):
    return S.grid(run(t).filter("rank <= 1").select("doc_id", "query_id"), k1=[0.4, 1.2], b=[0.3, 0.75])


# --- translation model ------------------------------------------------------------------

BITEXT = f"""
cv AS (SELECT conv_id, turn, role, {W('lower(text)')} AS w, lead(role) OVER o AS nrole, lead({W('lower(text)')}) OVER o AS nw FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
bi AS (SELECT conv_id * 1000 + turn AS pair, w AS src, nw AS dst FROM cv WHERE role = 'user' AND nrole = 'assistant' AND len(w) > 0 AND len(nw) > 0),
ps AS (SELECT pair, src, count(*)::DOUBLE AS ns FROM (SELECT pair, unnest(src) AS src FROM bi) GROUP BY ALL), pd AS (SELECT pair, dst, count(*)::DOUBLE AS nd FROM (SELECT pair, unnest(dst) AS dst FROM bi) GROUP BY ALL),
wp AS MATERIALIZED (SELECT * FROM ps JOIN pd USING (pair)),
c1 AS (SELECT src, dst, sum(e) AS c FROM (SELECT src, dst, nd * ns / sum(ns) OVER (PARTITION BY pair, dst) AS e FROM wp) GROUP BY ALL), t1 AS MATERIALIZED (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS p FROM c1),
c2 AS (SELECT src, dst, sum(e) AS c FROM (SELECT src, dst, nd * ns * p / sum(ns * p) OVER (PARTITION BY pair, dst) AS e FROM wp JOIN t1 USING (src, dst)) GROUP BY ALL), t2 AS MATERIALIZED (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS p FROM c2),
"""


def bitext(t: Tables) -> DataFrame:
    """Whole turns: what a user says, and the answer to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t.conversations.select("conv_id", "turn", "role", T.words(F.lower("text")).alias("w"))
    x = x.withColumn("_r", F.lead("role").over(w)).withColumn("_w", F.lead("w").over(w)).filter("role = 'user' and _r = 'assistant' and size(w) > 0 and size(_w) > 0")
    return x.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), F.col("w").alias("src"), F.col("_w").alias("dst"))


@query("SELECT pair, array_to_string(src, ' ') AS src, array_to_string(dst, ' ') AS dst FROM bi WHERE len(dst) <= len(src) * 1.5::DOUBLE AND len(src) <= len(dst) * 1.5::DOUBLE", BITEXT)
def m2_fertile_bitext(t):
    return M.fertile(bitext(t), 1.5).select("pair", F.array_join("src", " ").alias("src"), F.array_join("dst", " ").alias("dst"))


@query("SELECT src, dst, round(p, 6) AS p FROM t2", BITEXT)
def m3_em_training(t):
    return rounded(M.train(bitext(t), 2), "p")


RESCALED = "rs AS (SELECT src, dst, sum(p) AS p FROM (SELECT src, dst, p * 0.5::DOUBLE AS p FROM t2 WHERE p >= 0.01::DOUBLE UNION ALL SELECT DISTINCT src, src, 0.5::DOUBLE FROM t2 WHERE p >= 0.01::DOUBLE) GROUP BY ALL),"


@query("SELECT src, dst, round(p, 6) AS p FROM rs", BITEXT + RESCALED)
def m4_rescaled_table(t):
    return rounded(M.rescaled(M.filtered(M.train(bitext(t), 2, 0.01), 0.01), 0.5), "p")


@query("SELECT dst AS src, src AS dst, round(p, 6) AS p FROM rs", BITEXT + RESCALED)
def m4c_flipped_table(t):
    return rounded(M.flipped(M.rescaled(M.filtered(M.train(bitext(t), 2, 0.01), 0.01), 0.5)), "p")


@query("SELECT word, round(sum(tf) / (SELECT sum(tf) FROM post), 9) AS p_coll FROM post GROUP BY word", DOCS)
def m7_collection_probabilities(t):
    return M.collection_probabilities(index(t).occurrences).withColumn("p_coll", F.round("p_coll", 9))


@query("""SELECT query_id, doc_id, round(sum(qtf * (ln(0.9::DOUBLE * coalesce(tr, 0) + 0.1::DOUBLE * c) - ln(0.1::DOUBLE * c))) / greatest(count(*), 1), 6) AS model1 FROM (
 SELECT query_id, doc_id, word, qtf, tr, greatest(1e-9::DOUBLE, coalesce(pc, 0)) AS c FROM run JOIN qt USING (query_id)
 LEFT JOIN (SELECT query_id, doc_id, dst AS word, sum(p * tf / greatest(doc_len, 1)) AS tr FROM run JOIN post USING (doc_id) JOIN rs ON rs.src = post.word WHERE p >= 0.001::DOUBLE GROUP BY ALL) USING (query_id, doc_id, word)
 LEFT JOIN (SELECT word, sum(tf) / (SELECT sum(tf) FROM post) AS pc FROM post GROUP BY word) USING (word)) GROUP BY ALL""", RUN + BITEXT + RESCALED)
def x6_model1(t):
    of = X.Weighed(opened(t), terms(t))
    table = M.rescaled(M.filtered(M.train(bitext(t), 2, 0.01), 0.01), 0.5)
    return rounded(M.score(of.run, of.idx.postings, of.terms, table, M.collection_probabilities(of.idx.postings)), "model1")
