"""Operators 11 and 12 against plain counterparts, and 11's and 12's SQL."""

import glob
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ranklode.llm import hard_negatives, integers, queries, vector_codes

SCHEMA = "id long, label int, v array<double>, anchor boolean, b string, g int, rank int, entry string, error double"


def vectors(seed=3, n=260, dims=6):
    """Rows with copies, ties, odd vectors, null ids and labels, and columns of clashing names."""
    r = random.Random(seed)
    out = [[k, r.randrange(4), [r.gauss(0, 0.3) for _ in range(dims)], k % 9 == 0] for k in range(n)]
    for k in range(0, 60, 3):
        out[k + 100][2] = out[k][2]
    for k in range(200, 230):
        out[k][2] = [round(x, 1) for x in out[k][2]]
    out += [[900, 1, None, True], [901, 1, [0.1, None, 0.2], True], [902, 2, [float("nan")] * dims, True], [903, 2, [float("inf")] * dims, False], [904, None, [0.5] * dims, True]]
    out += [[905, 3, [], True], [906, 3, [0.9, -0.4], True], [None, 1, [0.4] * dims, True], [None, 2, [0.4] * dims, False], [907, 77, [0.3] * dims, True], [908, 2, [1e300] + [0.0] * (dims - 1), False]]
    out += [list(out[9]), list(out[0]), [9, 3, out[10][2], None]]
    r.shuffle(out)
    return [(*x, "b", 1, 2, "e", 0.5) for x in out]


def integer(v, dims):
    most = integers.limit(dims)
    return [int(max(-most, min(most, np.floor(x * 256)))) for x in v] + [0] * (dims - len(v))


def valid(rows):
    return [x for x in rows if x[2] is not None and all(y is not None and np.isfinite(y) for y in x[2])]


def mined(rows, n_positives=5, n_negatives=3, band=(50, 95)):
    kept = [(i, k, integer(v, 6), a) for i, k, v, a, *_ in valid(rows) if k is not None]
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for anchor, label, v, wanted in kept:
        if not wanted:
            continue
        scored = [(sum(a * b for a, b in zip(v, x[2], strict=True)), x[0], x[1]) for x in kept]
        for score, other, _ in sorted((s for s in scored if s[2] == label and (s[1] != anchor or anchor is None)), key=first)[:n_positives]:
            fits = sorted((s for s in scored if s[2] != label and band[0] * score <= 100 * s[0] <= band[1] * score), key=first)
            out += [(anchor, other, k + 1, s[1], score, s[0]) for k, s in enumerate(fits[:n_negatives])]
    return out


@pytest.fixture(scope="module")
def rows():
    return vectors()


def some(rows):  # a null anchor sorts
    return sorted(map(str, rows))


@pytest.mark.parametrize("sizes", [(4096, 256, 1 << 20), (16, 7, 40)])
def test_hard_negatives(spark, rows, sizes, monkeypatch):
    for name, n in zip(("ROWS", "ANCHORS", "GROUP_ROWS"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, n)
    got = hard_negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want = mined(rows)
    assert len(want) > 200
    # Rows of one id and score are one and the same to look at.
    assert some(map(tuple, got.collect())) == some(want)
    few = hard_negatives.mined(spark.createDataFrame(rows, SCHEMA), 2, 1, (10, 90))
    assert some(map(tuple, few.collect())) == some(mined(rows, 2, 1, (10, 90)))


def test_hard_negatives_of_nothing(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mined(empty).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([x for x in rows if not x[3]], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(1, 1, [0.5], True, "b", 1, 1, "e", 0.1)] * 3, SCHEMA)
    assert hard_negatives.mined(alone).collect() == []


def test_scan_by_planes():
    """Intervals never lose a pair, whichever digit leaves few enough to follow alone."""
    r = np.random.default_rng(5)
    for dims, top in ((1, 3), (64, 300), (70, 1 << 20)):
        a, x = (r.integers(-top, top, (n, dims)) for n in (9, 40))
        blocks = [hard_negatives.Block(dims, np.arange(len(m)), np.zeros(len(m), bool), np.zeros(len(m), np.int64), hard_negatives.planes(m)) for m in (a, x)]
        assert (blocks[1].values() == x).all()
        s = a @ x.T
        for low, high in ((np.sort(s)[:, -3], s.max(1)), (np.sort(s)[:, 10], np.sort(s)[:, 12]), (s.max(1) + 1, s.max(1) + 9)):
            barred = r.random(s.shape) < 0.2
            i, j, score = hard_negatives.scan(*blocks, low, high, barred.copy())
            assert set(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == {(p, q, s[p, q]) for p, q in zip(*np.nonzero((s >= low[:, None]) & (s <= high[:, None]) & ~barred), strict=True)}


def coded(rows, parts=16, entries=64, rounds=2):
    kept = [(i, k, v) for i, k, v, *_ in valid(rows)]
    dims = max((len(x[2]) for x in rows if x[2] is not None), default=0)
    wide = -(-dims // parts)
    q = [(i, k, integer(v, parts * wide), v) for i, k, v in kept]
    first = sorted(q, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[3]))[:entries]
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(x[2], p) for x in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((away(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        sums = [defaultdict(list) for _ in range(parts)]
        for x in q:
            for p in range(parts):
                sums[p][near(x[2], p)[1]].append(cut(x[2], p))
        books = [[[sum(c) // len(sums[p][k]) for c in zip(*sums[p][k], strict=True)] if k in sums[p] else e for k, e in enumerate(books[p])] for p in range(parts)]
    out = []
    for i, label, v, _ in q:
        best = [near(v, p) for p in range(parts)]
        out.append((i, label, [k for _, k in best], sum(d for d, _ in best)))
    return out, books


@pytest.mark.parametrize(("parts", "entries"), [(3, 8), (4, 64), (2, 500)])
def test_vector_codes(spark, rows, parts, entries):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, books = coded(rows, parts, entries)
    found = vector_codes.books(df, parts, entries)
    assert found.tolist() == books
    out = vector_codes.with_label_errors(vector_codes.encoded(df, found)).collect()
    assert some((r.id, r.label, r.code, r.error) for r in out) == some(want)
    per = defaultdict(int)
    for _, label, _, error in want:
        per[label] += error
    assert None in per and all(r.label_error == per[r.label] for r in out)


def test_annulus_is_whole():
    """The same entries as by trying all, fewer of them looked at."""
    r = np.random.default_rng(7)
    for top, wide in ((3, 2), (200, 4), (1 << 20, 3)):
        entries, x = r.integers(-top, top, (64, wide)), r.integers(-top, top, (500, wide))
        entries[40:50] = entries[:10]
        x[:64] = entries
        d = ((x[:, None] - entries) ** 2).sum(2)
        index, best, seen = vector_codes.Codebook(entries).nearest(x)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all() and seen < d.size
        assert (vector_codes.decoded(index[:, None], entries[None]) == entries[index]).all()


def test_vector_codes_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = vector_codes.books(empty)
    assert found.shape[:2] == (16, 0) and vector_codes.with_label_errors(vector_codes.encoded(empty, found)).collect() == []


def test_vectors_without_components(spark):
    df = spark.createDataFrame([(k, 1, [], k == 0, "b", 1, 1, "e", 0.1) for k in range(3)], SCHEMA)
    found = vector_codes.books(df)
    assert some(tuple(r) for r in vector_codes.encoded(df, found).collect()) == some((k, 1, [0] * 16, 0) for k in range(3))


def test_integers():
    column = pa.array([[0.5, -0.001], None, [], [None, 1.0], [float("inf"), 1.0], [1e300, -1e300]], pa.list_(pa.float64()))
    keep, x = integers.matrix(column.slice(0), 3)
    most = integers.limit(3)
    assert keep.tolist() == [True, False, True, False, False, True] and x.tolist() == [[128, -1, 0], [0, 0, 0], [most, -most, 0]]
    assert integers.matrix(column.slice(5), 2)[1].tolist() == [[integers.limit(2), -integers.limit(2)]]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert some(map(tuple, got.collect())) == some(tuple(r[k] for k in at) for r in want.fetchall())
