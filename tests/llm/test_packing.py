"""Operator 13 against the tokenizer, and its packing against plain counterparts."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ranklode.llm import kernels as K
from ranklode.llm import packing

ALPHABET = "ab .,'\n  é中1²_\x1c\u0085 　-Z"


@pytest.fixture(scope="module")
def encode():
    return packing.Encoder(packing.default_tokenizer())


def odd_texts(n=1500):
    r = random.Random(2)
    out = ["a b", "  a  b\n\n c  d 　 e\u0085 f", "", "it's 12,000.5€ naïve. \t\tx", "a\x1c b\x1d", "中文 。字" * 50, " \n", "    ", "é.", " . .", "_a_ b_c", "nul\x00 x", "\U0001f600 \U0001f600"]
    out += ["x" * 70_000 + ".y" * 10, "long " * 50_000, "中文字，" * 40_000, "foo<|endoftext|> bar <|endoftext|>"]
    return out + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_are_the_tokenizers(encode):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = odd_texts()
    short = [["é", "b"], ["é", " b"], ["", "é", "", ".a", "中", " "], ["a", ".", " ", "\u00a0", " x"], ["é"], [" "]]
    for some in (texts, [x for x in texts if "<|" not in x], texts[13:14], [""], [], *short):
        for again in range(2):
            ids, bounds = encode(K.texts(pa.array(some, pa.string())))
            for k, x in enumerate(some):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(x, add_special_tokens=False).ids, (again, x[:60])


def test_ids_after_forgetting(encode, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 10)
    one, two = packing.Encoder(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    t = K.texts(pa.array(odd_texts(100)[:13]))
    want = encode(t)
    for e in (one, one, two):
        assert all((a == b).all() for a, b in zip(e(t), want, strict=True))


def by_trial(lengths, capacity):
    """By trying everything, longest first."""
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_patterns():
    r = random.Random(4)
    for case in range(60):
        capacity = r.choice((10, 16, 30))
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 9))), reverse=True)
        count = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
        seeded = bool(case % 2)
        found = packing.patterns(count, capacity, seeded)
        took = np.zeros(capacity + 1, np.int64)
        left = list(lengths)
        for times, pattern in found:
            for length, k in pattern:
                took[length] += times * k
            for _ in range(times):  # each is the fullest combination of what is left
                full = max(s for n in range(len(left) + 1) for c in itertools.combinations(left, n) if (s := sum(c)) <= capacity and (not seeded or max(left) in c))
                assert sum(length * k for length, k in pattern) == full
                for length, k in pattern:
                    for _ in range(k):
                        left.remove(length)
        assert (took == count).all() and not left
        assert sum(t for t, _ in packing.fewest(count, capacity)) <= by_trial(lengths, capacity) + 1, (case, lengths)


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((x for x in room if x >= n), default=None)
        if fit is None:
            room.append(capacity - n)
        else:
            room.remove(fit)
            room.append(fit - n)
    return len(room)


def test_patterns_beat_best_fit():
    r = random.Random(6)
    for top, n in ((400, 500), (1024, 300), (120, 2000)):
        lengths = [r.randint(1, top) for _ in range(n)]
        got = sum(t for t, _ in packing.fewest(np.bincount(lengths, minlength=1025)))
        assert -(-sum(lengths) // 1024) <= got <= best_fit(lengths, 1024)
    many = packing.fewest(np.full(1025, 10**9) * (np.arange(1025) > 0))  # as many as may be
    assert sum(t * sum(a * b for a, b in p) for t, p in many) == 10**9 * 1024 * 1025 // 2


@pytest.mark.parametrize("capacity", [1024, 40])
def test_packing(spark, docs, rows, encode, capacity):
    got = packing.packed(docs, capacity=capacity).collect()
    want = []
    for doc, text, *_ in rows:
        ids = [*encode.plain(text or ""), packing.END]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc, k, a, b - a, ids[a:b]) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for x in by.values():
        x.sort()
        assert [a for a, _, _ in x] == [0, *itertools.accumulate(n for _, n, _ in x)][:-1] and sum(n for _, n, _ in x) <= capacity
    assert len(by) <= best_fit([r.length for r in got], capacity)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(docs, capacity=capacity).collect()}
    assert sorted(map(len, whole.values())) == sorted(sum(len(y) for *_, y in x) for x in by.values())
    sums = packing.digests(docs, capacity=capacity)
    assert sorted(str((r.doc_id, r.piece, r.ids_crc32)) for r in sums.collect()) == sorted(str((r.doc_id, r.piece, zlib.crc32(r.ids))) for r in got)
    assert dict(sums.dtypes)["length"] == "bigint"


def test_packing_of_nothing(spark, none):
    assert packing.packed(none).collect() == [] and packing.digests(none).collect() == [] and packing.sequences(none).collect() == []
