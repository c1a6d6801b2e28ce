import hashlib
import random
import re
from collections import Counter

from ranklode.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    far = 1 << 63
    words = [(far if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (far, far)), (d, i))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if d == far else d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_digests(docs, rows):
    got = Counter(tuple(r)[:4] for r in S.digests(docs).collect())
    assert got == brute(rows)
    assert sum(k[2] > 0 for k in got) > 20


def test_other_window(docs, rows):
    assert Counter(tuple(r)[:4] for r in S.digests(docs, 7).collect()) == brute(rows, 7)


def test_factors_point_to_equal_earlier_words(docs, rows):
    words = {r[0]: WORD.findall(r[1] or "") for r in rows if r[0] is not None}
    found = [f for f in S.factors(docs).collect() if f.doc_id is not None]
    assert found
    for f in found:
        a, b = words[f.doc_id], words[f.ref_doc_id]
        assert f.length >= 20 and (f.ref_doc_id, f.ref_start) < (f.doc_id, f.start)
        assert a[f.start : f.start + f.length] == b[f.ref_start : f.ref_start + f.length]


def test_dedup_keeps_the_rest(docs, rows):
    want = Counter()
    for (doc, _, removed, digest), times in brute(rows).items():  # rows can differ in n_words alone
        want[doc, removed, digest] += times
    out = S.dedup(docs).collect()
    assert Counter((r.doc_id, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out) == want


def parsed(rows, window=20):
    """Greedy factors, longest by trial, against the places at which runs stand first."""
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    stands = set(first.values())  # the reference: runs at their first places, neighbours in one piece
    out = []
    for d, w in words.items():
        known = [first[tuple(w[i : i + window])] < (d, i) for i in range(len(w) - window + 1)]
        i = 0
        while i < len(known):
            if not known[i]:
                i += 1
                continue
            best = (0, None)
            for rd, rs in stands:
                n = 0
                while i + n < len(known) and known[i + n] and (rd, rs + n) in stands and words[rd][rs + n : rs + n + window] == w[i + n : i + n + window]:
                    n += 1
                best = max(best, (n, (rd, rs)), key=lambda x: x[0])
            n, place = best
            end = i + n - 1 + window
            out.append((d, i, end - i, *place))
            straddling = [j for j in range(max(i + n, end - window + 1), min(end, len(known))) if known[j]]
            i = end if end < len(known) and known[end] or not straddling else straddling[-1]
    return sorted(out)


def test_factors_are_greedy_and_longest(spark):
    r = random.Random(12)
    say = lambda k: [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)]
    a, b, c = say(90), say(70), say(30)
    texts = [a, b, [*say(30), *a[20:80], *say(5)], [*a[:45], *b[10:40], *a[50:90]], [*b[30:70], *b[:60]], [*c[:25], *c[5:]], ["x"] * 70, ["x", "y", "z"] * 30, [*a, *b], say(15), []]
    texts += [texts[8], [*texts[3], *c], [*b, *b, *b]]
    data = [(7 * k % 41, " ".join(w), "t") for k, w in enumerate(texts)]
    found = S.factors(spark.createDataFrame(data, "doc_id long, text string, start string")).collect()
    got = sorted(tuple(x) for x in found)
    assert got == parsed(data) and max(x[2] for x in got) >= 60


def test_ids_at_the_edge(spark):
    w = " ".join(f"w{i}" for i in range(30))
    top = (1 << 63) - 1
    data = [(None, w), (top, w), (top, "new " + w), (-top - 1, "other " * 3), (None, "a " + w), (3, None)]
    got = Counter(tuple(r)[:4] for r in S.digests(spark.createDataFrame(data, "doc_id long, text string")).collect())
    places = [((d is None, d or 0), t) for d, t in data]
    want = brute([(sorted({p for p, _ in places}).index(p), t) for p, t in places])
    names = {sorted({p for p, _ in places}).index((d is None, d or 0)): d for d, _ in data}
    assert got == Counter({(names[k[0]], *k[1:]): v for k, v in want.items()})
    assert {(x.doc_id, x.ref_doc_id, x.ref_start) for x in S.factors(spark.createDataFrame(data, "doc_id long, text string")).collect()} == {(None, top, 0), (top, top, 0)}


def test_empty(none):
    assert S.digests(none).collect() == [] and S.factors(none).collect() == []


def test_neighbouring_documents(spark):
    w = [f"w{i}" for i in range(60)]
    data = [(1, w[:20]), (2, w[:20]), (3, w[20:45]), (4, w[20:45]), (5, ["x", *w[30:60]]), (6, [*w[40:60], "y"])]
    data = [(i, " ".join(x)) for i, x in data]
    for some in (data[:2], data, [(1, " ".join(w[:15]))], [(1, " ".join(w[:k])) for k in (9,)], [(1, "a " * 10)]):
        got = Counter(tuple(r)[:4] for r in S.digests(spark.createDataFrame(some, "doc_id long, text string")).collect())
        assert got == brute(some)
    assert {r.doc_id: r.n_removed for r in S.digests(spark.createDataFrame(data[:2], "doc_id long, text string")).collect()} == {1: 0, 2: 20}
