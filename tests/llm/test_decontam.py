"""Decontamination of texts that repeat themselves, and how often items are read."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ranklode.llm import decontam
from ranklode.llm import kernels as K


def shard(texts):
    return decontam.Shard(decontam._postings(np.arange(len(texts)), np.zeros(len(texts), bool), K.texts(pa.array(texts))))


def items(texts, window=10):
    w = K.words(K.texts(pa.array(texts)), K.ALNUM, lower=True)
    return decontam.Items([str(k) for k in range(len(texts))], w.bounds, w.hash, window)


def test_one_word_over_and_over():
    doc, item = shard(["zero " * 200_000, "one zero " * 50, "nothing"]), items(["zero " * 10_000, "one zero one"])
    tracemalloc.start()
    began = time.time()
    (got,) = decontam._judged([doc], [item])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - began < 10 and peak < 1 << 30
    assert got.column("n_hit").to_pylist() == [200_000, 99, 0] and got.column("n_items").to_pylist() == [1, 1, 0]


@pytest.mark.parametrize("slices", [(1 << 15, 1 << 20), (3, 5)])
def test_few_words_many_windows(slices, monkeypatch):
    """Texts of two words, against occurrences found by trial."""
    monkeypatch.setattr(decontam, "SLICE_WINDOWS", slices[0])
    monkeypatch.setattr(decontam, "SLICE_SEEDS", slices[1])
    r = random.Random(3)
    say = lambda n: [r.choice("ab") for _ in range(n)]
    docs, tests = [say(n) for n in (300, 40, 9, 0, 120)], [say(n) for n in (60, 12, 4, 1, 0, 12)]
    tests += [tests[1], tests[0][:20]]
    (got,) = decontam._judged([shard([" ".join(d) for d in docs])], [items([" ".join(t) for t in tests])])
    for k, d in enumerate(docs):
        hit, names = set(), set()
        for name, t in enumerate(tests):
            n = min(len(t), 10)
            for w in {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if n else ():
                for i in range(len(d) - n + 1):
                    if tuple(d[i : i + n]) == w:
                        hit |= set(range(i, i + n))
                        names.add(str(name))
        row = {c: got.column(c)[k].as_py() for c in ("n_hit", "n_items", "contaminated")}
        assert row == {"n_hit": len(hit), "n_items": len(names), "contaminated": bool(hit)}


def test_blocks_are_read_once_a_take(monkeypatch):
    """However many rows and batches: as often as texts fill TAKE_BYTES."""
    monkeypatch.setattr(decontam, "TAKE_BYTES", 10_000)
    reads = []

    def blocks():
        reads.append(1)
        yield items(["never said at all"])

    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": ["some words " * 10] * 10}) for _ in range(30)]  # 33,000 bytes
    for some in decontam._gathered(iter(batches), 1):
        assert sum(b.num_rows for b in decontam._kept(some, 1, blocks())) == sum(b.num_rows for b in some)
    assert 3 <= len(reads) <= 4
    rows = pa.RecordBatch.from_pylist([decontam._postings(np.arange(1), np.zeros(1, bool), K.texts(pa.array(["some words " * 50]))) for _ in range(100)])
    assert 5 <= len(list(decontam._taken([rows]))) <= 7
