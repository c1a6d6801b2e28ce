import gzip
import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest

from ranklode.llm import chat, mixing, token_counts, warc
from ranklode.session import shared_dir

PAGES = [(5, "http://a/", "z" * 200), (3, "http://b/", "z" * 200), (9, None, "z" * 200), (4, "u", None), (None, "u", "z" * 200), (1, "s", "y" * 50), (2, "s\r\nx", "y" * 50), (7, "http://c/", "é" * 70), (8, "http://d/", "é" * 70), (6, "l", "w\r\n\r\n" * 90_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*x, "clash", 1) for x in PAGES], "page_id long, url string, html string, record_type string, payload int")


def wanted():
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = h in first and i != first[h]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return Counter(out)


def test_warc_round_trip(spark, pages):
    assert Counter(map(tuple, warc.round_trip(pages).collect())) == wanted()
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_filters_and_foreign_archives(spark, pages, tmp_path):
    path = shared_dir(spark, "warc")
    warc.archive(pages, path)
    own = warc.read(spark, path)
    assert {r.record_id for r in warc.read(spark, path, payload=False).filter("warc_type = 'revisit' and target_uri like 'http%'").collect()} == {"<urn:page:5>", "<urn:page:8>"}
    assert {r.record_id for r in own.filter("target_uri in ('http://a/', 'http://c/')").collect()} == {"<urn:page:5>", "<urn:page:7>"}
    data = b"".join(gzip.open(os.path.join(path.removeprefix("file://"), f)).read() for f in sorted(os.listdir(path.removeprefix("file://"))) if f.endswith(".gz"))
    (tmp_path / "plain.warc").write_bytes(data)
    starts = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", data)] + [len(data)]
    os.mkdir(tmp_path / "gz")
    (tmp_path / "gz/x.warc.gz").write_bytes(b"".join(gzip.compress(data[a:b]) for a, b in zip(starts, starts[1:], strict=False)))
    for other in (tmp_path / "plain.warc", tmp_path / "gz"):
        assert Counter(map(tuple, warc.summary(warc.read(spark, str(other))).collect())) == wanted()
        assert warc.read(spark, str(other), payload=False).filter("warc_type = 'response'").count() == sum(v for k, v in wanted().items() if k[3] == "response")


def test_skipping_does_not_inflate(spark, pages, monkeypatch):
    path = shared_dir(spark, "warc")
    warc.archive(pages, path)
    reader = warc.WarcReader({"path": path})
    reader.tests = [("warc_type", "in", {"revisit"})]
    inflated = []
    more = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self, limit=warc.STEP: (inflated.append(limit), more(self, limit))[1])
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == sum(v for k, v in wanted().items() if k[3] == "revisit")
    assert sum(inflated) < 200_000 < sum(len((h or "")) for _, _, h in PAGES)


def test_token_counts(spark, docs, rows, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    got = Counter((r.doc_id, r.n_tokens, r.closed) for r in token_counts.counted(docs).collect())
    assert got == Counter((r[0], len(sp.encode(r[1] or "")), True) for r in rows)
    assert token_counts.counted(none).collect() == []


@pytest.mark.parametrize("block", [2, 6, 10, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    import numpy as np

    docs = [[5, 6, 7], [], [8] * 40, [9], [], [], [1, 3]]
    flat = [x for d in docs for x in (*d, 2)] + [4, 4]
    (tmp_path / "a.tokens").write_bytes(np.array(flat, "<u2").tobytes())
    (tmp_path / "b.tokens").write_bytes(np.array([7, 7, 7], "<u2").tobytes())
    got = sorted((r.file, r.ordinal, r.n_tokens, r.closed) for r in token_counts.scan(spark, str(tmp_path), 2, block).collect())
    assert got == [("a.tokens", k, len(d), True) for k, d in enumerate(docs)] + [("a.tokens", len(docs), 2, False), ("b.tokens", 0, 3, False)]


TURNS = [
    (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 1, "user", "hi"), (2, 2, "assistant", "hello"), (2, 3, "user", "more"), (3, 10, "user", "hi"), (3, 20, "assistant", "hello"), (3, 30, "user", "more"),
    (4, 1, "user", "hi"), (5, 1, "user", None), (6, 1, "user", ""), (7, 1, None, "hi"), (8, 1, "user", "hi"), (8, 1, "user", "hi"), (None, 1, "user", "alone"), (9, None, "user", "q"), (9, 1, "assistant", "a"), (10, 1, "system", "hi"),
]


def test_chat(spark):
    c = spark.createDataFrame([(*x, "clash", 1) for x in TURNS], "conv_id long, turn long, role string, text string, place string, size int")
    out = chat.rendered(c)
    got = {r.conv_id: r.text for r in out.collect()}
    assert set(got) == {2, 5, 6, 7, 8, None, 9, 10}
    assert got[2] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nmore\n<|end|>\n"
    con = duckdb.connect()
    con.register("conversations", c.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert Counter(map(tuple, con.sql(chat.SQL).fetchall())) == Counter((r.conv_id, r.n_turns, r.text) for r in out.collect())
    assert chat.rendered(c.limit(0)).collect() == []


def test_mixing(spark, docs, rows, none):
    out = mixing.shares(docs)
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in out.collect())
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = con.sql(mixing.SQL.replace("$DOCS", "documents")).fetchall()
    assert got == Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in want)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while True:  # the stated rule, literally
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    assert all(abs(r.target - target[source[r.doc_id]]) < 1e-6 for r in out.collect() if r.doc_id is not None)
    assert all(r.taken <= 2 * r.size for r in out.collect())
    copies = Counter(r.doc_id for r in mixing.emit(docs).collect())
    assert mixing.emit(docs).columns == docs.columns and copies == Counter({k: sum(r.copies for r in out.collect() if r.doc_id == k) for k in copies})
    assert mixing.shares(none).collect() == [] and mixing.emit(none).collect() == []
