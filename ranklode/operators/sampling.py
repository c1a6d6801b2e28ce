"""Samples, splits, training sets and checks. Chance comes from md5 of an id and a seed, so
every sample is the same in any order of the rows and on any number of machines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.operators.ordering import numbered, running
from ranklode.session import cut, dealt, parts


def order_key(id_, seed: str = "0") -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), T.col(id_).cast("string")))


def uniform(id_, seed: str = "0") -> Column:
    """From 0 to 1."""
    return F.conv(F.substring(order_key(id_, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample(df: DataFrame, id_: str, n: int, seed: str = "0") -> DataFrame:
    """Exactly n rows (or all): the n least keys, by a distributed top-n."""
    return df.withColumn("_k", order_key(id_, seed)).orderBy("_k", id_).limit(n).drop("_k")


def weighted_with_replacement(df: DataFrame, id_: str, weight: str, n: int, seed: str = "0") -> DataFrame:
    """n draws with chance proportional to weight: draw, id. A draw meets the running sums of the
    one range of ids that it falls to."""
    bad = df.agg(F.min(weight), F.sum(weight)).first()
    if bad[0] is None or bad[0] < 0 or bad[1] <= 0:
        raise ValueError("weights must not be negative, nor all zero")
    x = df.select(F.col(id_).alias("id"), F.col(weight).cast("double").alias("_w"))
    x, ranges = running(x, "_w", "id", name="_hi")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform("id", seed) * float(bad[1])).alias("_u"))
    starts = F.array(*(F.lit(float(before)) for _, before, _ in ranges))  # one number for each range
    at = F.size(F.filter(starts, lambda s: s <= F.col("_u"))) - 1
    draws = draws.withColumn("_range", F.element_at(F.array(*(F.lit(r) for r, _, _ in ranges)), at + 1))
    return x.join(draws, "_range").filter((F.col("_u") >= F.col("_hi") - F.col("_w")) & (F.col("_u") < F.col("_hi"))).select("draw", "id")


def split_by_sizes(df: DataFrame, id_: str, sizes: dict[str, int | None], seed: str = "0") -> DataFrame:
    """Rows with column ``part``. One size may be open; the others must leave it the rest."""
    total = df.count()
    known = sum(v for v in sizes.values() if v is not None)
    if sum(v is None for v in sizes.values()) > 1 or known > total or (None not in sizes.values() and known != total):
        raise ValueError(f"sizes {sizes} don't cover {total} rows")
    x = numbered(df, order_key(id_, seed), id_, name="_r")
    part, at = F.lit(None).cast("string"), 0
    for name, size in reversed(list(sizes.items())):
        part = F.when(F.col("_r") <= total - at, F.lit(name)).otherwise(part)
        at += size if size is not None else total - known
    return x.withColumn("part", part).drop("_r")


def split_by_chance(df: DataFrame, id_: str, parts: dict[str, float], seed: str = "0") -> DataFrame:
    if abs(sum(parts.values()) - 1) > 1e-6:
        raise ValueError("probabilities must add up to 1")
    u, part = uniform(id_, seed), F.lit(list(parts)[-1])
    upto = 0.0
    edges = []
    for name, p in parts.items():
        upto += p
        edges.append((name, upto))
    for name, edge in reversed(edges[:-1]):
        part = F.when(u < edge, F.lit(name)).otherwise(part)
    return df.withColumn("part", part)


def folds(queries: DataFrame, n: int) -> DataFrame:
    """query_id, fold: contiguous in query order, the remainder to the last."""
    total = queries.count()
    size = max(total // n, 1)
    at = F.col("_at") - 1
    return numbered(queries.select("query_id"), "query_id", name="_at").select("query_id", F.least(F.floor(at / size), F.lit(n - 1)).cast("int").alias("fold"))


def judged_or_sampled(docs: DataFrame, qrels: DataFrame, p: float, seed: str = "0") -> DataFrame:
    """Documents that are relevant to something, and a share p of all others."""
    good = qrels.filter("grade > 0").select("doc_id").distinct().withColumn("_rel", F.lit(True))
    return docs.join(good, "doc_id", "left").filter(F.col("_rel") | (uniform("doc_id", seed) < p)).drop("_rel")


def training_pairs(run: DataFrame, qrels: DataFrame, docs: DataFrame, hard: int, medium: int, easy: int, seed: str = "0") -> DataFrame:
    """query_id, doc_id, kind: positives; the ``hard`` best negatives, ``medium`` sampled from
    the other candidates and judged negatives; ``easy`` from the collection (by a hash of query
    and document, among the documents of the hash's own bucket: no pairing of all with all)."""
    pos = qrels.filter("grade > 0").select("query_id", "doc_id")
    queries = pos.select("query_id").distinct()
    pool = run.select("query_id", "doc_id", "rank").unionByName(qrels.filter("grade <= 0").select("query_id", "doc_id", F.lit(None).cast("int").alias("rank")))
    pool = pool.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).join(queries, "query_id", "left_semi").join(pos, ["query_id", "doc_id"], "left_anti")
    by_rank = Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last(), F.desc("doc_id"))
    pool = pool.withColumn("_r", F.row_number().over(by_rank))
    is_hard = (F.col("_r") <= hard) & F.col("rank").isNotNull()
    key = order_key(F.concat_ws("/", "query_id", "doc_id"), seed)
    rest = pool.filter(~is_hard).withColumn("_m", F.row_number().over(Window.partitionBy("query_id").orderBy(key)))
    out = pos.withColumn("kind", F.lit("positive")).unionByName(pool.filter(is_hard).select("query_id", "doc_id", F.lit("hard").alias("kind")))
    out = out.unionByName(rest.filter(F.col("_m") <= medium).select("query_id", "doc_id", F.lit("medium").alias("kind")))
    if easy:
        n = docs.count()
        buckets = max(1, n // max(4 * easy, 16))
        b = lambda c: F.pmod(F.conv(F.substring(F.md5(T.col(c).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets))
        some = queries.withColumn("_b", b(F.concat_ws(":", F.lit(seed), "query_id"))).join(docs.select("doc_id").withColumn("_b", b("doc_id")), "_b")
        some = some.join(pos, ["query_id", "doc_id"], "left_anti").withColumn("_e", F.row_number().over(Window.partitionBy("query_id").orderBy(key)))
        out = out.unionByName(some.filter(F.col("_e") <= easy).select("query_id", "doc_id", F.lit("easy").alias("kind")))
    return out


def test_export(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Candidates of queries with a relevant document: place from 0 and score -place."""
    good = qrels.filter("grade > 0").select("query_id").distinct()
    return run.join(good, "query_id", "left_semi").select("query_id", "doc_id", (F.col("rank") - 1).alias("pos"), (-(F.col("rank") - 1)).cast("double").alias("score"))


def chunk_sampler(pairs: DataFrame, n_neg: int, epoch: int = 0) -> DataFrame:
    """query_id, slot, doc_id, positive: one positive (slot 0) and n negatives for each query; all
    negatives and then repeats where there are fewer. Rows (query_id, doc_id, positive)."""
    key = order_key(F.concat_ws("/", "query_id", "doc_id"), str(epoch))
    same, every = Window.partitionBy("query_id", "positive"), Window.partitionBy("query_id")
    x = dealt(pairs.filter("query_id is not null and positive is not null"), "query_id")
    x = x.withColumn("_r", F.row_number().over(same.orderBy(key)) - 1).withColumn("_n", F.count("*").over(same).cast("int"))
    x = x.withColumn("_both", F.max("positive").over(every) & F.max(~F.col("positive")).over(every)).filter("_both")
    x = x.filter(F.col("_r") < F.when(F.col("positive"), 1).otherwise(n_neg))
    again = F.filter(F.sequence(F.col("_r"), F.col("_r") + F.lit(n_neg) * F.col("_n"), F.col("_n")), lambda s: s < n_neg)
    slot = F.explode(F.when(F.col("positive"), F.array(F.lit(0))).otherwise(F.transform(again, lambda s: s + 1)))
    return x.select("query_id", slot.alias("slot"), "doc_id", "positive")


def pseudo_labels(run: DataFrame, k: int, grade: float = 1.0) -> DataFrame:
    return run.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(grade).alias("grade"))


def run_faults(run: DataFrame, docs: DataFrame, least: int = 1) -> DataFrame:
    """query_id, fault: rising scores, repeated or unknown documents, too few results."""
    n = parts(run, docs)
    known = dealt(docs.select("doc_id").distinct().withColumn("_known", F.lit(True)), "doc_id", n=n)
    x = dealt(run.select("query_id", "doc_id", "rank", "score"), "doc_id", n=n).join(known, "doc_id", "left")
    by_rank, by_doc = Window.partitionBy("query_id").orderBy("rank"), Window.partitionBy("query_id").orderBy("doc_id")
    x = dealt(x, "query_id", n=n).withColumn("_p", F.lag("score").over(by_rank)).withColumn("_d", F.lag(F.struct("doc_id")).over(by_doc))
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    x = x.groupBy("query_id").agg(
        has(F.col("score") > F.col("_p")).alias("rising score"), has(F.col("_d").eqNullSafe(F.struct("doc_id"))).alias("repeated document"),
        has(F.col("_known").isNull()).alias("unknown document"), (F.count("*") < least).alias("too few results"),
    )
    faults = F.array(*(F.when(F.col(c), F.lit(c)) for c in x.columns[1:]))
    return x.select("query_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


def split_faults(whole: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Rows that only the whole has, or only the parts have."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return whole.exceptAll(every).withColumn("fault", F.lit("missing")).unionByName(every.exceptAll(whole).withColumn("fault", F.lit("extra")))


def token_overlap(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a_id, b_id, jaccard >= least of rows (id, text), ``least`` above 0.

    A text's words are put in order from rare to common; two texts that are alike enough share one
    of their first n - ceil(least * n) + 1 words. Only those words meet, so a word that most texts
    have pairs nothing but texts made of such words; the pairs are then compared in full."""
    x, y = (d.select(F.col("id").alias(f"{s}_id"), F.array_distinct(T.tokens("text")).alias(f"{s}_w")).filter(F.size(f"{s}_w") > 0) for d, s in ((a, "a"), (b, "b")))
    x, y = cut(x, "words"), cut(y, "words")
    df = cut(x.select(F.explode("a_w").alias("word")).unionByName(y.select(F.explode("b_w").alias("word"))).groupBy("word").agg(F.count("*").alias("_df")), "frequencies")

    def first(d, s):
        order = d.select(f"{s}_id", F.size(f"{s}_w").alias(f"{s}_n"), F.explode(f"{s}_w").alias("word")).join(df, "word")
        order = order.groupBy(f"{s}_id", f"{s}_n").agg(F.sort_array(F.collect_list(F.struct("_df", "word")))["word"].alias("_o"))
        return order.select(f"{s}_id", f"{s}_n", F.explode(F.slice("_o", F.lit(1), (F.col(f"{s}_n") - F.ceil(F.lit(least) * F.col(f"{s}_n") - 1e-9) + 1).cast("int"))).alias("word"))

    fits = (F.col("a_n") >= least * F.col("b_n")) & (F.col("b_n") >= least * F.col("a_n"))
    pairs = first(x, "a").join(first(y, "b"), "word").filter(fits).select("a_id", "b_id").distinct()
    both = pairs.join(x, "a_id").join(y, "b_id").withColumn("_n", F.size(F.array_intersect("a_w", "b_w")))
    j = F.col("_n") / (F.size("a_w") + F.size("b_w") - F.col("_n"))
    return both.select("a_id", "b_id", j.alias("jaccard")).filter(F.col("jaccard") >= least)


def grid(df: DataFrame, **values: list) -> DataFrame:
    """Each row with each combination of a bounded list of parameters."""
    for name, v in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, v))))
    return df


def scored_negatives(run: DataFrame, qrels: DataFrame, hard: int, medium: int, train_from: int, positives_from: int, seed: str = "0") -> DataFrame:
    """query_id, doc_id, score, kind: candidates only, with their scores, of queries that have a
    relevant one among the first max(train_from, positives_from): the relevant ones, the ``hard``
    best others, and ``medium`` more drawn from the irrelevant ones of the first ``train_from``."""
    good = qrels.filter("grade >= 1").select("query_id", "doc_id", F.lit(True).alias("_rel")).distinct()
    x = run.filter(F.col("rank") <= max(train_from, positives_from)).select("query_id", "doc_id", "rank", "score").join(good, ["query_id", "doc_id"], "left")
    rel = F.coalesce("_rel", F.lit(False))
    x = x.withColumn("_any", F.max(rel).over(Window.partitionBy("query_id"))).filter("_any").withColumn("_rel", rel)
    pool = (~F.col("_rel")) & (F.col("rank") <= train_from)
    draw = Window.partitionBy("query_id", pool).orderBy(order_key(F.concat_ws("/", "query_id", "doc_id"), seed))
    kind = F.when(F.col("_rel"), "positive").when(F.col("rank") <= hard, "hard").when(pool & (F.col("_m") <= medium), "medium")
    return x.withColumn("_m", F.row_number().over(draw)).select("query_id", "doc_id", "score", kind.alias("kind")).filter("kind is not null")


def export_training(queries: DataFrame, docs: DataFrame, pairs: DataFrame, path: str) -> None:
    """Training texts and pairs below a folder: texts of the queries (id, text) and documents
    (id, text) that the pairs (query_id, doc_id[, score]) name. Queries with empty texts go, with
    their pairs."""
    from ranklode.sources import files, formats

    queries = queries.filter(F.trim("text") != "")
    pairs = cut(pairs.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi"), "pairs")
    some = lambda d, c: d.join(pairs.select(F.col(c).alias("id")).distinct(), "id", "left_semi")
    files.write_training_texts(some(queries, "query_id"), some(docs, "doc_id"), f"{path}/texts")
    formats.write_pairs(pairs, f"{path}/pairs")


def split_leaks(a: DataFrame, b: DataFrame, qrels_a: DataFrame, qrels_b: DataFrame, docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Queries (id, text) of two splits whose words are alike by ``least`` (a_id, b_id, jaccard), and
    of their relevant documents the words' likeness (a_id, b_id, a_doc, b_doc, jaccard)."""
    near = cut(token_overlap(a, b, least), "near")
    w = docs.select("doc_id", F.array_distinct(T.tokens("text")).alias("w"))
    side = lambda q, s: q.filter("grade > 0").select(F.col("query_id").alias(f"{s}_id"), "doc_id").distinct().join(w, "doc_id").withColumnsRenamed({"doc_id": f"{s}_doc", "w": f"{s}_w"})
    x = near.select("a_id", "b_id").join(side(qrels_a, "a"), "a_id").join(side(qrels_b, "b"), "b_id")
    both = F.size(F.array_intersect("a_w", "b_w"))
    either = F.size("a_w") + F.size("b_w") - both
    return near, x.select("a_id", "b_id", "a_doc", "b_doc", F.when(either > 0, both / either).otherwise(0.0).alias("jaccard"))


#: Brackets of a range of values, and rows of a bracket whose values are counted one by one.
BRACKETS, FEW_VALUES = 1024, 4096


# The quantiles of reports on leaks.
LEAK_QUANTILES = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 0.999)
# End of fixed values.


def quantiles(df: DataFrame, value: str, at) -> DataFrame:
    """quantile, value: exact quantiles (between the neighbours of a place, in proportion), by counts.

    The values' range is cut into ``BRACKETS`` brackets and their rows are counted; the brackets that hold
    a place that is asked for are cut again, until each holds few different values or none can be
    told apart. What reaches the driver is a count a bracket, and at last the counts of few
    values: no task sorts or holds all of them. Null and NaN values count as none."""
    x = cut(df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)"), "values")
    inf = float("inf")
    finite = (F.col("x") > -inf) & (F.col("x") < inf)
    n, least, some, low, high = x.agg(F.count("*"), F.count_if(F.col("x") == -inf), F.count_if(finite), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))).first()
    if not n:
        return df.sparkSession.createDataFrame([(float(q), None) for q in at], "quantile double, value double")
    places = sorted({p for q in at for p in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    found: dict[int, float] = {}
    todo = [(-inf, -inf, 0, least), (low, high, least, some), (inf, inf, least + some, n - least - some)]  # bounds (inclusive), rows before, rows
    while todo:
        after = []
        for lo, hi, before, rows in todo:
            asked = [p for p in places if before <= p < before + rows]
            if not asked:
                continue
            here = x.filter((F.col("x") >= lo) & (F.col("x") <= hi))
            width = hi / BRACKETS - lo / BRACKETS
            if not width > 0 or rows <= FEW_VALUES or lo + width == lo:
                at_ = before
                for v, c in sorted(tuple(r) for r in here.groupBy("x").agg(F.count("*").alias("n")).collect()):
                    found.update({p: v for p in asked if at_ <= p < at_ + c})
                    at_ += c
                continue
            k = F.least(F.floor((F.col("x") - lo) / width), F.lit(BRACKETS - 1)).cast("int").alias("k")
            at_ = before
            for _, lo2, hi2, c in sorted(tuple(r) for r in here.groupBy(k).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()):
                if any(at_ <= p < at_ + c for p in asked):
                    after.append((lo2, hi2, at_, c))
                at_ += c
        todo = after
    out = []
    for q in at:
        p = q * (n - 1)
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out.append((float(q), a if a == b else a + (b - a) * (p - math.floor(p))))
    return df.sparkSession.createDataFrame(out, "quantile double, value double")


def quantile_report(df: DataFrame, value: str, at=LEAK_QUANTILES) -> DataFrame:
    """quantile, value."""
    return quantiles(df, value, at)


def replaced_validation(entries: DataFrame, qrels: DataFrame, run: DataFrame, old: DataFrame, other_entries: DataFrame, other_qrels: DataFrame, other_run: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (id, ...), judgements and run with the validation queries ``old`` (query_id) taken out
    and another set's put in; texts that both have stay as they are."""
    texts = entries.unionByName(other_entries.join(entries.select("id"), "id", "left_anti"))
    without = lambda d: d.join(old.select("query_id"), "query_id", "left_anti")
    return texts, without(qrels).unionByName(other_qrels), without(run).unionByName(other_run)


def by_query(pairs: DataFrame, n_neg: int, seed: str = "0") -> DataFrame:
    """query_id, step, pos_id, neg_id: a query is used up before the next: each of its positives in
    turn with ``n_neg`` negatives, which go round. Rows (query_id, doc_id, positive)."""
    key = order_key(F.concat_ws("/", "query_id", "doc_id"), seed)
    x = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "positive").orderBy(key)) - 1)
    pos = x.filter("positive").select("query_id", F.col("doc_id").alias("pos_id"), F.col("_r").alias("_p"))
    neg = x.filter(~F.col("positive")).select("query_id", F.col("doc_id").alias("neg_id"), F.col("_r").alias("_k"), F.count("*").over(Window.partitionBy("query_id")).alias("_n"))
    slots = pos.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_neg - 1)))).withColumn("step", F.col("_p") * n_neg + F.col("_s"))
    sizes = neg.select("query_id", "_n").distinct()
    slots = slots.join(sizes, "query_id").withColumn("_k", F.pmod(F.col("step"), F.col("_n")))
    return slots.join(neg.drop("_n"), ["query_id", "_k"]).select("query_id", "step", "pos_id", "neg_id")


# Settings that are tried for BM25, the translation model and feedback.
BM25_B, BM25_K1 = tuple(round(0.3 + 0.1 * i, 1) for i in range(8)), tuple(round(0.4 + 0.2 * i, 1) for i in range(7))
MODEL1_SELF = (0.05, 0.1, 0.15, 0.25, 0.3, 0.35, 0.45, 0.5, 0.55, 0.6, 0.7, 0.75)
MODEL1_LAMBDA = (0.05, 0.1, 0.15, 0.25, 0.3, 0.35, 0.45, 0.5)
MODEL1_MORE = ((0.6, 0.05), (0.7, 0.05), (0.8, 0.05), (0.9, 0.05), (0.9, 0.01), (0.9, 0.001), (0.9, 0.0001))
RM3_WEIGHT, RM3_SIZES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24)
# End of fixed values.


def bm25_settings(spark) -> DataFrame:
    return spark.createDataFrame([(k1, b) for b in BM25_B for k1 in BM25_K1], "k1 double, b double")


def model1_settings(spark) -> DataFrame:
    return spark.createDataFrame([*((s, x) for s in MODEL1_SELF for x in MODEL1_LAMBDA), *MODEL1_MORE], "p_self double, lam double")


def rm3_settings(spark) -> DataFrame:
    return spark.createDataFrame([(w, d, t) for w in RM3_WEIGHT for d in RM3_SIZES for t in RM3_SIZES], "weight double, top_docs int, top_terms int")


def annotated(questions: DataFrame, notes: DataFrame) -> DataFrame:
    """id, note of questions (id, text): the first note (place, text, note) with the same text, else
    the first with the same set of words. Notes of one text, or of one set, become one before they
    meet questions."""
    key = lambda c: F.sort_array(F.array_distinct(T.tokens(c)))
    one = lambda k, by: notes.filter("text is not null").groupBy(k.alias(by)).agg(F.min(F.struct("place", "note"))["note"].alias(f"_n{by}"))
    q = questions.filter("text is not null").select("id", F.col("text").alias("_t"), key("text").alias("_k"))
    both = q.join(one(F.col("text"), "_t"), "_t", "left").join(one(key("text"), "_k"), "_k", "left")
    return both.select("id", F.coalesce("_n_t", "_n_k").alias("note")).filter("note is not null")
