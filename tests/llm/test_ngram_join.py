import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ranklode.llm import components as C
from ranklode.llm import ngram_join as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return Counter((d, len(s), None if d is None else top(d)) for d, s in sets)


@pytest.mark.parametrize("unit", [4096, 2])
def test_components(docs, rows, monkeypatch, unit):
    monkeypatch.setattr(N, "UNIT", unit)  # 2: groups of several blocks
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.classes(docs).collect())
    assert got == brute(rows)


def _words(r, k):
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(k)]


def test_near_copies_over_many_blocks_leave_no_pair(spark, monkeypatch):
    import random

    monkeypatch.setattr(N, "UNIT", 8)
    asked = []
    sides = N._sides
    monkeypatch.setattr(N, "_sides", lambda marked: asked.append(1) or sides(marked))
    r = random.Random(3)
    base, data = _words(r, 200), []
    for k in range(120):
        w = list(base)
        w[r.randrange(200)] = f"x{k % 40}"
        data.append((k, " ".join(w)))
    got = N.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and not asked


def test_links_between_the_largest_component_and_the_rest(spark, monkeypatch):
    import random

    monkeypatch.setattr(N, "UNIT", 3)
    r = random.Random(4)
    pieces = [_words(r, 22) for _ in range(9)]  # texts of common pieces: alike, but not all linked
    data = [(k, " ".join(w for p in sorted(r.sample(range(9), 7)) for w in pieces[p])) for k in range(60)]
    data += [(100 + k, " ".join(w for p in (0, 1, 2, 3, 4, 5, 6, k % 3) for w in pieces[p])) for k in range(40)]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in N.classes(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == brute(data) and len({k[2] for k in got}) > 3


def test_one_of_each(docs, rows):
    want = brute(rows)
    stay = {k[0] for k in want if k[0] is None or k[0] == k[2]}
    got = N.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows if r[0] in stay)


def test_empty(none):
    assert N.classes(none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_trees_find_what_pairs_find(seed):
    r = np.random.default_rng(seed)
    base = [r.integers(0, 1 << 62, r.integers(3, 120)).astype(np.uint64) for _ in range(40)]
    sets = []
    for k in range(400):
        s = base[k % 40].copy()
        swap = r.random(len(s)) < 0.12 * r.random()
        s[swap] = r.integers(0, 1 << 62, swap.sum()).astype(np.uint64)
        sets.append(np.unique(s))
    u, v = map(np.array, zip(*[(i, j) for i in range(400) for j in range(i) if N.linked(sets[i], sets[j])], strict=True))
    want = C.local(400, u, v)
    found = N._within(np.arange(400), sets)
    got = C.local(400, *(np.array([p[k] for p in found]) for k in (0, 1)))
    assert (want == got).all()
    a, b = np.arange(0, 400, 2), np.arange(1, 400, 2)
    ta, tb = (N.Tree(x, [sets[k] for k in x], 512) for x in (a, b))
    across = N.join_trees(ta, tb, N.Forest(np.arange(400)))
    odd = (u % 2) != (v % 2)
    want = C.local(400, u[odd], v[odd])
    got = C.local(400, *(np.array([p[k] for p in across]) for k in (0, 1)))
    assert (want == got).all()


def test_connected_components(spark):
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (160, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    got = {x.node: x.comp for x in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node, comp in got.items():
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert comp == min(seen)
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
