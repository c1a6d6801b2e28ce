"""Quality rules: base rules, then robust multivariate outliers for each language and source.

Every document becomes a vector of transformed statistics. For each pair of language and
source the minimum-covariance-determinant estimate is fitted to all of its documents that pass
the base rules. There are three starts: medians and median deviations as they are, with the
correlations of the hyperbolic tangents of the standardised values, and with their spatial signs.
From each, concentration steps take the documents nearest to the estimate, three quarters of
them, and estimate mean and covariance anew, until the determinant falls no more; ``MOST_STEPS``
bounds the steps, and a start that hasn't settled by then keeps the least determinant it has
seen. The start with the least determinant gives the group's estimate. A document is rejected if
its squared Mahalanobis distance, scaled so that the median one is that of a normal vector, is
above the cut-off. Statistics hardly vary in most groups (no symbols, no repeated lines): where
the covariance is less than the floors allow, the floors stand for it, in determinants too, and
the median is that of a normal vector in the dimensions left.

Pairs with fewer than ``least`` documents are judged by an estimate over all documents of the
language; where even that has fewer, the base rules decide alone, as a rare language is no outlier
of the others. ``judged_by`` says which of these it was. A concentration step is one pass: moments
are summed by fine bins of the distance, and bins are taken up to the quantile, so the subset is
exact to a bin, the same in any order of the rows, and no group is ever gathered.

Null texts are empty; null languages and sources are values of their own; rows that repeat
are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ranklode.llm import kernels as K
from ranklode.session import cut, ship

NOT_NEWLINE = ~K.byte_class((0x0A, 0x0A))
SYMBOL = K.byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))
STATS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))])
STATS_DDL = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST, KEEP, BINS = 60, 0.75, 32
#: Concentration steps from a start at most, and the least fall of the determinant's logarithm that counts.
MOST_STEPS, FALL = 10, 1e-3
#: The 0.999 quantile of chi-square with five degrees of freedom: the cut-off for squared distances.
CUT_OFF = 20.515
#: Tables of groups with at most so many rows (some 30 MB) are broadcast.
BROADCAST_GROUPS = 50_000
P = 5
HALF = [(i, j) for i in range(P) for j in range(i, P)]
#: No direction counts as less spread than this: covariances are singular otherwise.
FLOOR = (0.15, 0.08, 0.08, 0.1, 0.08)


def _again(text: np.ndarray, h: np.ndarray):
    """Of values within texts: which have an equal one before, and which have one at all."""
    key = h + (text + 1).astype(K.U64) * K.U64(0x9E6C63D0876A9A47)
    order = np.argsort(K.mix(key), kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    later, some = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    some[order[1:]] = same
    some[order[:-1]] |= same
    return later, some


def measure(t: K.Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each text."""
    parts = []
    for i, j in K.slices(t.offsets):
        a = t.offsets[i]
        part = K.Texts(t.data[a : t.offsets[j]], t.offsets[i : j + 1] - a)
        w = K.words(part)
        chars = K.sums(K.SPACED[part.data] & ((part.data & 0xC0) != 0x80), part.offsets)
        symbols = K.sums(SYMBOL[part.data], part.offsets)
        lines = K.words(part, NOT_NEWLINE)
        worded = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
        twice, _ = _again(lines.text_of(), lines.hash)
        at = K.whole(w.bounds, 3)
        _, some = _again(w.text_of()[at], K.grams(w.hash, 3)[at])
        repeat = K.covered(at[some], 3, len(w.start))
        parts.append([w.counts(), chars, symbols, K.sums(worded & twice, lines.bounds), K.sums(repeat, w.bounds), K.sums(worded, lines.bounds)])
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6


def _measured(batches):
    for b in batches:
        s = measure(K.texts(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(x, pa.int64()) for x in s)], schema=STATS)


def statistics(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return narrow.mapInArrow(_measured, STATS_DDL)


def _vector() -> list[F.Column]:
    n = F.col("n_words").cast("double")
    return [
        F.log1p(n),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _quantile(df: DataFrame, keys: list[str], value: F.Column, q: float) -> DataFrame:
    """keys, _at: the least bin (an integer ``value``) up to which a share q of a key's rows lies."""
    counts = df.groupBy(*keys, value.alias("_bin")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    run = F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_run", run).withColumn("_all", F.sum("_c").over(w)).filter(F.col("_run") >= q * F.col("_all")).groupBy(*keys).agg(F.min("_bin").alias("_at"))


def _bin(d2: F.Column) -> F.Column:
    return F.floor(F.log(d2 + 1e-6) * BINS).cast("long")


FIT_DDL = "g string, s int, mean array<double>, inv array<double>, vary double, logdet double"


def _inverse(batches):
    """Rows of a group and start (mean, upper half of the covariance by rows) to rows with the
    inverse covariance, the number of dimensions that vary and the determinant's logarithm: in
    units of the floors no eigenvalue of the covariance is taken below 1."""
    floor = np.array(FLOOR)
    unit = np.outer(floor, floor)
    for b in batches:
        n = b.num_rows
        half = np.array(b.column("cov").to_pylist(), float).reshape(n, -1)
        full = np.zeros((n, P, P))
        for k, (i, j) in enumerate(HALF):
            full[:, i, j] = full[:, j, i] = half[:, k]
        w, v = np.linalg.eigh(full / unit)
        inv = (v / np.maximum(w, 1.0)[:, None, :]) @ v.transpose(0, 2, 1) / unit
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [b.column("g"), b.column("s"), b.column("mean"), pa.array(inv.reshape(n, -1).tolist(), doubles), pa.array(np.clip(w, 0.0, 1.0).sum(1)), pa.array(np.log(np.maximum(w, 1.0)).sum(1))],
            names=["g", "s", "mean", "inv", "vary", "logdet"],
        )


def _distance(mean: str, inv: str) -> F.Column:
    z = [f"(x{i} - {mean}[{i}])" for i in range(P)]
    return F.expr(f"greatest({' + '.join(f'{1.0 if i == j else 2.0}D * {inv}[{i * P + j}] * {z[i]} * {z[j]}' for i, j in HALF)}, 0D)")


def _median(k: F.Column) -> F.Column:
    """The median of chi-square with k degrees of freedom (Wilson and Hilferty)."""
    return k * F.pow(1 - 2 / (9 * k), F.lit(3.0))


def _few(df: DataFrame) -> DataFrame:
    """A table of a row or a few for each group: written, and broadcast while it is small, so that
    a group which holds a third of all rows isn't shuffled to one task."""
    return _counted(df, F.lit(1))[0]


def _counted(df: DataFrame, what: F.Column) -> tuple[DataFrame, int]:
    """The written table, and for how many rows ``what`` isn't null: counted while it is written."""
    seen = Observation()
    df = cut(df.observe(seen, F.count("*").alias("n"), F.count(what).alias("some")), "groups")
    return F.broadcast(df) if seen.get["n"] <= BROADCAST_GROUPS else df, seen.get["some"]


def _at_distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    return rows.join(fit.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g")).withColumn("d2", _distance("mean", "inv")).drop("_g", "mean", "inv")


def _moments(x: list[str]) -> list[F.Column]:
    names = ["double(count(*)) m0", *(f"sum({v}) m{1 + i}" for i, v in enumerate(x)), *(f"sum({x[i]} * {x[j]}) m{1 + P + k}" for k, (i, j) in enumerate(HALF))]
    return list(map(F.expr, names))


MEANS = [f"m{1 + i} / m0" for i in range(P)]
COVARIANCES = [f"(m{1 + P + k} - m{1 + i} * m{1 + j} / m0) / m0" for k, (i, j) in enumerate(HALF)]


def _fitted(sums: DataFrame) -> DataFrame:
    """Fits from rows (g, s, m0, ...) of summed moments."""
    return sums.selectExpr("g", "s", f"array({', '.join(MEANS)}) mean", f"array({', '.join(COVARIANCES)}) cov").mapInArrow(_inverse, FIT_DDL)


def concentrated(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """A step: fits to the share KEEP of each group's rows that is nearest by each given fit."""
    sums = _moments([f"x{i}" for i in range(P)])
    bins = _at_distance(rows, fit.select("g", "s", "mean", "inv")).groupBy("g", "s", _bin(F.col("d2")).alias("_bin")).agg(*sums)
    w = Window.partitionBy("g", "s")
    upto = F.sum("m0").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m0")
    near = bins.withColumn("_before", upto).withColumn("_all", F.sum("m0").over(w)).filter(F.col("_before") < KEEP * F.col("_all"))
    return _fitted(near.groupBy("g", "s").agg(*(F.expr(f"sum(m{k}) m{k}") for k in range(len(sums)))))


def _starts(rows: DataFrame) -> DataFrame:
    """Three fits for each group: by medians and median deviations alone, with the correlations of
    tanh of the standardised values, and with the scatter of their spatial signs."""
    long = rows.select("g", F.posexplode(F.array(*(F.col(f"x{i}") for i in range(P)))).alias("f", "x"))
    fine = 256.0
    mid = _few(_quantile(long, ["g", "f"], F.floor(F.col("x") * fine).cast("long"), 0.5))
    off = long.join(mid.withColumnRenamed("g", "_g").withColumnRenamed("f", "_f"), (F.col("g") == F.col("_g")) & (F.col("f") == F.col("_f")))
    off = off.withColumn("dev", F.abs(F.col("x") - F.col("_at") / fine))
    mad = _quantile(off.drop("_at"), ["g", "f"], F.floor(F.col("dev") * fine).cast("long"), 0.5).withColumnRenamed("_at", "_dev")
    floor = F.element_at(F.array(*map(F.lit, FLOOR)), F.col("f") + 1)
    robust = mid.join(mad, ["g", "f"]).withColumn("spread", F.greatest(F.lit(1.4826) * (F.col("_dev") + 1) / fine, floor))
    robust = robust.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("f", (F.col("_at") / fine).alias("m"), "spread"))).alias("r"))  # five a group
    robust = _few(robust.select(F.col("g").alias("_g"), F.col("r")["m"].alias("mean"), F.col("r")["spread"].alias("spread")))
    at = rows.join(robust, F.col("g") == F.col("_g")).selectExpr("g", *(f"(x{i} - mean[{i}]) / spread[{i}] z{i}" for i in range(P)))
    at = at.selectExpr("*", f"greatest({' + '.join(f'z{i} * z{i}' for i in range(P))}, 1e-18D) size")
    signs = [F.expr(f"sum(z{i} * z{j} / size) u{k}") for k, (i, j) in enumerate(HALF)]
    sums = at.groupBy("g").agg(*_moments([f"tanh(z{i})" for i in range(P)]), *signs).join(robust, F.col("g") == F.col("_g"))
    variance = [f"greatest({COVARIANCES[HALF.index((i, i))]}, 1e-6D)" for i in range(P)]
    plain = [f"spread[{i}] * spread[{j}]" if i == j else "0D" for i, j in HALF]
    bent = [f"spread[{i}] * spread[{j}] * {COVARIANCES[k]} / sqrt({variance[i]} * {variance[j]})" for k, (i, j) in enumerate(HALF)]
    sign = [f"spread[{i}] * spread[{j}] * {P} * u{k} / m0" for k, (i, j) in enumerate(HALF)]
    each = ", ".join(f"struct({k} s, array({', '.join(c)}) cov)" for k, c in enumerate((plain, bent, sign)))
    return sums.selectExpr("g", "mean", f"explode(array({each})) e").selectExpr("g", "e.s", "mean", "e.cov").mapInArrow(_inverse, FIT_DDL)


def settled(rows: DataFrame) -> DataFrame:
    """g, s, mean, inv, vary, logdet, steps, done: each start's fit of least determinant. ``done``
    is false where the steps were used up first."""
    # a start's own scatter comes from no subset: any fit is better
    state = _few(_starts(rows).withColumn("logdet", F.lit(float("inf"))).withColumn("steps", F.lit(0)).withColumn("done", F.lit(False)))
    for _ in range(MOST_STEPS):
        new = concentrated(rows, state.filter("not done")).selectExpr("g _g", "s _s", "mean _mean", "inv _inv", "vary _vary", "logdet _logdet")
        both = state.join(new, F.expr("g = _g and s = _s"), "left").selectExpr("*", f"coalesce(_logdet < logdet - {FALL}D, false) fell")
        kept = [f"if(fell, _{k}, {k}) {k}" for k in ("mean", "inv", "vary", "logdet")]
        state, left = _counted(both.selectExpr("g", "s", *kept, "steps + int(not done) steps", "done or not fell done"), F.expr("nullif(done, true)"))
        if not left:
            break
    return state


def estimates(rows: DataFrame) -> DataFrame:
    """_g, mean, inv (of the covariance), scale, logdet: from rows (g, x0..x4)."""
    best = settled(rows).groupBy("g").agg(F.min(F.struct("logdet", "s", "mean", "inv", "vary")).alias("b"))
    fit = _few(best.select("g", "b.mean", "b.inv", "b.vary", "b.logdet"))
    mid = _quantile(_at_distance(rows, fit.select("g", "mean", "inv")), ["g"], _bin(F.col("d2")), 0.5).withColumnRenamed("g", "_g")
    scale = F.exp((F.col("_at") + 1) / BINS) / _median(F.greatest(F.col("vary"), F.lit(1.0)))
    scale = F.when(F.col("vary") < 1, F.greatest(scale, F.lit(1.0))).otherwise(scale)  # nothing varies: the floors are the scale
    return _few(fit.join(mid, F.col("g") == F.col("_g")).select("_g", "mean", "inv", scale.alias("scale"), "logdet"))


def _failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _groups() -> tuple[F.Column, F.Column]:
    """Names of a row's pair of language and source, and of its language."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.concat(text(F.col("lang")), F.lit("\t"), text(F.col("source"))), text(F.col("lang"))


def _model(stats: DataFrame, least: int):
    """From statistics with base_failed: the rows to judge with their group and vector, the group
    that judges each pair, and the estimates."""
    pair, lang = _groups()
    fitted = stats.filter("not base_failed")
    pairs = cut(fitted.groupBy(pair.alias("_pair"), lang.alias("_lang")).agg(F.count("*").alias("_n")), "pairs")
    langs = pairs.groupBy("_lang").agg(F.sum("_n").alias("_all"), F.min("_n").alias("_least"))
    big, whole = F.col("_n") >= least, F.col("_all") >= least
    g = F.when(big, F.col("_pair")).when(whole, F.col("_lang")).alias("g")
    by = F.when(big, "pair").when(whole, "language").alias("by")
    fits = F.array_compact(F.array(F.when(big, F.col("_pair")), F.when(whole & (F.col("_least") < least), F.col("_lang")))).alias("fits")
    groups = _few(pairs.join(langs, "_lang").select("_pair", g, by, fits))
    rows = fitted.select("*", pair.alias("pair")).join(groups, F.col("pair") == F.col("_pair"))
    rows = rows.select("doc_id", *STATS.names[3:], "lang", "source", "g", "by", "fits", *(v.alias(f"x{i}") for i, v in enumerate(_vector())))
    rows = cut(rows, "vectors")
    return rows, groups, estimates(rows.select(F.explode("fits").alias("g"), *(f"x{i}" for i in range(P))))


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The statistics of each document with base_failed, judged_by (``pair``, ``language``, or null
    where the base rules decide alone), distance (null there too) and kept."""
    stats = cut(statistics(docs).withColumn("base_failed", _failed()), "stats")
    rows, _, fit = _model(stats, least)
    seen = rows.join(fit, F.col("g") == F.col("_g"), "left").withColumn("distance", _distance("mean", "inv") / F.col("scale"))
    out = [F.col(k) for k in ("doc_id", "lang", "source", *STATS.names[3:])]
    seen = seen.select(*out, F.lit(False).alias("base_failed"), F.col("by").alias("judged_by"), "distance", F.coalesce(F.col("distance") <= CUT_OFF, F.lit(True)).alias("kept"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = stats.filter("base_failed").select(*out, "base_failed", none("string").alias("judged_by"), none("double").alias("distance"), F.lit(False).alias("kept"))
    return seen.unionByName(bad)


def keep(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents that all rules keep, with their columns. Each row is judged by itself,
    whatever its doc_id: it is measured again and meets the estimates, and no text is shuffled
    unless the groups are too many to broadcast."""
    _, groups, fit = _model(cut(statistics(docs).withColumn("base_failed", _failed()), "stats"), least)

    def measured(batches):
        for b in batches:
            row = b.column(0)
            s = measure(K.texts(row.field("text").cast(pa.string())))
            yield pa.RecordBatch.from_arrays([row, *(pa.array(x, pa.int64()) for x in s)], names=["_row", *STATS.names[3:]])

    schema = StructType([StructField("_row", docs.schema, False), *(StructField(k, LongType()) for k in STATS.names[3:])])
    rows = docs.select(F.struct("*").alias("_row")).mapInArrow(measured, schema).filter(~_failed())
    rows = rows.withColumn("lang", F.col("_row.lang").cast("string")).withColumn("source", F.col("_row.source").cast("string"))
    rows = rows.select("_row", _groups()[0].alias("pair"), *(v.alias(f"x{i}") for i, v in enumerate(_vector())))
    rows = rows.join(groups.select("_pair", "g"), F.col("pair") == F.col("_pair")).join(fit, F.col("g") == F.col("_g"), "left")
    return rows.filter(F.coalesce(_distance("mean", "inv") / F.col("scale") <= CUT_OFF, F.lit(True))).select("_row.*")
