"""One text that is longer than any slice, shard or chunk, beside short ones; ties."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ranklode.llm import chunks, decontam, kernels, langid, mixing, ngram_join, quality, secrets, substring_dedup, token_counts
from ranklode.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def long_rows():
    r = random.Random(41)
    words = [f"{''.join(r.choice('abcdefghij') for _ in range(5))}{k}" for k in range(480_000)]
    text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
    assert len(text) > max(chunks.CHUNK_BYTES, decontam.SHARD_BYTES, kernels.SPLIT_BYTES, langid.SLICE)
    key = "Zx9Qw7Lm2Kt8Vb4Np6Rj1Hs5Dg3F"
    return words, [(1, text, "en"), (2, text, "en"), (3, " ".join(words[1000:1060]), "de"), (4, text + f"\ntoken: {key} end", "de"), (5, "short", "en")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame([(*x, "s") for x in long_rows[1]], "doc_id long, text string, lang string, source string").repartition(3).cache()


def test_long_text_dedup(long_docs, long_rows):
    got = {r.doc_id: r for r in substring_dedup.digests(long_docs).collect()}
    n = len(long_rows[0])
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed, got[3].n_removed, got[4].n_words, got[4].n_removed, got[5].n_removed) == (n, 0, n, 60, n + 3, n, 0)
    assert (got[2].n_factors, got[3].n_factors, got[4].n_factors) == (1, 1, 1)


def test_long_text_join_and_hits(spark, long_docs, long_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(long_docs).collect()}
    n = len(long_rows[0])
    assert got == {1: (n - 4, 1), 2: (n - 4, 1), 3: (56, 3), 4: (n - 1, 1), 5: (1, 5)}
    items = spark.createDataFrame([(7, " ".join(long_rows[0][470_000:470_010])), (8, " ".join(long_rows[0][1010:1030]))], "item_id long, text string")
    hits = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.judged(long_docs, items).collect()}
    assert hits == {1: (30, 2), 2: (30, 2), 3: (20, 1), 4: (30, 2), 5: (0, 0)}


def test_long_text_scans(spark, long_docs, long_rows):
    spans = {r.doc_id: (r.n_assign, r.spans) for r in secrets.scan(long_docs).collect()}
    at = len(long_rows[1][0][1]) + 1
    assert spans[4][0] == 1 and spans[4][1].endswith(f"assign:{at}:{at + 35}") and spans[1][0] == 0
    stats = {r.doc_id: (r.n_words, r.word_chars, r.n_dup_lines) for r in quality.statistics(long_docs).collect()}
    assert stats[1] == (len(long_rows[0]), sum(map(len, long_rows[0])), 0) and stats[5] == (1, 5, 0)
    path = shared_dir(spark, "long-tokens")
    token_counts.write(long_docs, path)
    counts = [token_counts.scan(spark, path, block_bytes=b).join(token_counts.ids(spark, path), ["file", "ordinal"]) for b in (1 << 16, 8 << 20)]
    small, large = ({r.doc_id: r.n_tokens for r in c.collect()} for c in counts)
    assert small == large and small[1] == small[2] > len(long_rows[0]) and small[5] < 5


def test_equal_quotients_in_the_mix(spark):
    data = [(k, " ".join(["w"] * n), s) for k, (n, s) in enumerate([(30, "a"), (10, "b"), (20, "c"), (30, "d"), (10, "e"), (20, "f"), (0, "g"), (0, "h"), (5, None)])]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.sql(mixing.SQL.replace("$DOCS", "documents")).fetchall())
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.shares(docs).collect()) == want
    assert docs.filter(F.lit(False)).count() == 0
