"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the text before it. The reference is that text without its
repeats: of each run of ``window`` words the first place (smallest doc_id, then earliest start).
It is held in indexed blocks; block b has the places of the runs whose hash falls to it, and a
document's runs are looked up in all of them. As a run stands in the reference once, there is one
place to extend a factor from, and the longest factor is that which follows it word by word.

A document is parsed greedily from left to right: from the first run that has an earlier place
the factor goes on as long as the next run's place is the next word of the reference; the parse
goes on at the factor's end. Where no run starts there, the runs that straddle the end are
checked, and the last one that has an earlier place starts the next factor, which overlaps the
one before. So the factors, all of at least ``window`` words, cover just the words of runs that
also start earlier: those are the duplicate spans. A copy of a text that itself repeats an earlier
one is parsed into factors of both.

Most text repeats nowhere, so a filter comes first: each run is known by an anchor, the
least hash among its shorter runs of words; equal runs have equal anchors, and only runs
whose anchor another chunk of documents has as well are looked up. Word hashes have 64 bits
and runs are compared by 128.

Null texts have no words. Rows with a null doc_id come behind all others and are returned
with it; rows that share a doc_id are one position, so neither repeats the other. Runs
within one document count from their second start. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ranklode.llm import kernels as K
from ranklode.llm.chunks import by_bucket, chunked, ddl, packed, rows, shared_hashes
from ranklode.session import ship

WINDOW = 20
#: Starts in rows without id are moved so far that their places come behind all others.
FAR = 1 << 30
FACTORS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_factors", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])


class _Chunk:
    """Words and runs of a chunk's documents, in order of doc_id."""

    def __init__(self, table: pa.Table, window: int):
        doc, null = K.ids(table.column("doc_id"))
        order = np.lexsort((null, doc))
        self.doc, self.null, self.window = doc[order], null[order], window
        self.texts = K.texts(table.column("text").combine_chunks().take(pa.array(order)))
        self.words = K.words(self.texts)
        k = (window + 1) // 2
        self.at = K.whole(self.words.bounds, window)  # first word of each run
        g = K.mix(K.grams(self.words.hash, k))
        near = [g[: len(g) - p][g[: len(g) - p] == g[p:]] for p in range(1, min(window - k + 2, len(g)))]
        self.near = np.unique(np.concatenate([g[:0], *near]))  # come again before a run is over
        self.anchor = K.sliding_min(g, window - k + 1)[self.at]

    def anchors(self) -> np.ndarray:
        """Distinct, sorted; neighbours mostly share theirs."""
        a = self.anchor
        return np.unique(a[np.r_[True, a[1:] != a[:-1]]]) if len(a) else a

    def look_up(self, shared: np.ndarray):
        """Of the runs whose anchor is shared or comes more than once here: index into
        ``at``, two hashes, and the rank of the first equal run."""
        a = self.anchor
        text = np.searchsorted(self.words.bounds, self.at, side="right")  # a document's first run starts a group
        head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])]) if len(a) else np.zeros(0, np.int64)
        value, times = np.unique(a[head], return_counts=True)
        ok = K.member(a[head], np.unique(np.concatenate([shared, value[times > 1], self.near])))
        size = np.diff(np.r_[head, len(a)])
        i = K.ranges(head[ok], size[ok])
        h1 = K.mix(K.grams(self.words.hash, self.window, K.GRAM1)[self.at[i]])
        h2 = K.mix(K.grams(K.mix(self.words.hash, 1), self.window, K.GRAM2)[self.at[i]])
        keys = (h2, h1)
        if (self.doc[1:] == self.doc[:-1]).any():  # rows that share an id: their words aren't in order of place
            keys = (*self.place(i)[::-1], *keys)
        order = np.lexsort(keys)
        new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])] if len(i) else np.zeros(0, bool)
        first = np.empty(len(i), np.int64)
        first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(i) else 0
        return i, h1, h2, first

    def place(self, i: np.ndarray):
        """doc_id and start within the document of runs."""
        at = self.at[i]
        text = np.searchsorted(self.words.bounds, at, side="right") - 1
        return self.doc[text], (at - self.words.bounds[text] + FAR * self.null[text]).astype(np.int32)


def _parsed(docs: DataFrame, window: int, finish, schema: pa.Schema) -> DataFrame:
    ship(docs.sparkSession)
    d = chunked(docs)
    buckets = d.buckets
    tell, ask, answer = packed("b c | h"), packed("b c | h1 h2 doc start"), packed("c | doc start rdoc rstart")

    def anchors(key, table):
        a = _Chunk(table, window).anchors()
        c = key[0].as_py()
        return rows(tell, [(b, c, K.blob(x)) for b, x in by_bucket((K.mix(a, 2) % K.U64(buckets)).astype(np.int32), a)])

    def runs(key, table, shared):
        c = key[0].as_py()
        if not table.num_rows:
            return ask.empty_table()
        chunk = _Chunk(table, window)
        known = np.sort(K.join_blobs(shared.column("h"), K.U64))
        i, h1, h2, first = chunk.look_up(known)
        mine = np.flatnonzero((first == np.arange(len(i))) & K.member(chunk.anchor[i], known))
        doc, start = chunk.place(i[mine])
        bucket = (h2[mine] % K.U64(buckets)).astype(np.int32)
        return rows(ask, [(b, c, *map(K.blob, x)) for b, *x in by_bucket(bucket, h1[mine], h2[mine], doc, start)])

    def block(table):
        """An indexed block of the reference: the first place of each run, for who asks."""
        kinds = {"h1": K.U64, "h2": K.U64, "doc": np.int64, "start": np.int32}
        x = {k: K.join_blobs(table.column(k), v) for k, v in kinds.items()}
        c = np.repeat(table.column("c").to_numpy(), [len(v) // 8 for v in table.column("h1").to_pylist()])
        order = np.lexsort((x["start"], x["doc"], x["h2"], x["h1"]))
        s = {k: v[order] for k, v in x.items()}
        new = np.r_[True, (s["h1"][1:] != s["h1"][:-1]) | (s["h2"][1:] != s["h2"][:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        rdoc, rstart = s["doc"][first], s["start"][first]
        later = (rdoc < s["doc"]) | ((rdoc == s["doc"]) & (rstart < s["start"]))
        return rows(answer, [(b, *map(K.blob, v)) for b, *v in by_bucket(c[order][later], s["doc"][later], s["start"][later], rdoc[later], rstart[later])])

    def parse(key, table, shared, known):
        if not table.num_rows:
            return schema.empty_table()
        chunk = _Chunk(table, window)
        i, h1, h2, first = chunk.look_up(np.sort(K.join_blobs(shared.column("h"), K.U64)))
        doc, start = chunk.place(i)
        rdoc, rstart = doc[first].copy(), start[first].copy()  # the first here, unless a block knows an earlier one
        there = {k: K.join_blobs(known.column(k), v) for k, v in (("doc", np.int64), ("start", np.int32), ("rdoc", np.int64), ("rstart", np.int32))}
        if len(there["doc"]):
            mine = np.flatnonzero(first == np.arange(len(i)))
            order = np.lexsort((there["start"], there["doc"]))
            at = _find(doc[mine], start[mine], there["doc"][order], there["start"][order])
            hit = at >= 0
            src = order[at[hit]]
            place = np.full(len(i), -1)
            place[mine[hit]] = src
            got = place[first] >= 0
            rdoc[got], rstart[got] = there["rdoc"][place[first][got]], there["rstart"][place[first][got]]
        again = (rdoc < doc) | ((rdoc == doc) & (rstart < start))
        order = np.flatnonzero(again)  # i is ascending: documents in order, starts in order
        head, length = greedy(chunk.at[i[order]], rdoc[order], rstart[order], window)
        at = order[head]
        return finish(chunk, chunk.at[i[at]], length, rdoc[at], rstart[at])

    told = d.docs.groupBy("c").applyInArrow(anchors, ddl(tell))
    shared = shared_hashes(told, K.U64)
    asked = d.docs.groupBy("c").cogroup(shared.groupBy("c")).applyInArrow(runs, ddl(ask))
    known = asked.groupBy("b").applyInArrow(block, ddl(answer))
    # both answers travel to the chunk as one table, told apart by the empty columns
    both = shared.selectExpr("c", "h", "cast(null as binary) doc", "cast(null as binary) start", "cast(null as binary) rdoc", "cast(null as binary) rstart").unionByName(known.selectExpr("c", "cast(null as binary) h", "doc", "start", "rdoc", "rstart"))
    return d.docs.groupBy("c").cogroup(both.groupBy("c")).applyInArrow(lambda key, table, x: parse(key, table, x, x), ddl(schema))


def _find(doc, start, docs, starts):
    """Index of (doc, start) among the sorted (docs, starts), or -1."""
    keys = np.unique(np.r_[doc, docs])
    k = lambda d, s: np.searchsorted(keys, d).astype(np.int64) << 32 | s
    have, want = k(docs, starts), k(doc, start)
    at = np.searchsorted(have, want)
    at[at == len(have)] = 0
    return np.where(have[at] == want, at, -1)


def greedy(at: np.ndarray, rdoc: np.ndarray, rstart: np.ndarray, window: int):
    """The parse: from the ascending words at which runs with an earlier place start, and those
    places, the index of each factor's first run and the factor's words."""
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.r_[(at[1:] != at[:-1] + 1) | (rdoc[1:] != rdoc[:-1]) | (rstart[1:] != rstart[:-1] + 1), True]
    last = np.flatnonzero(ends)[np.cumsum(np.r_[0, ends[:-1]])]  # the last run that follows the same place
    end = at[last] + window
    onward = np.searchsorted(at, end)
    there = (onward < n) & (at[np.minimum(onward, n - 1)] == end)
    straddles = (onward - 1 > last) & (at[onward - 1] + window > end)
    onward = np.where(~there & straddles, onward - 1, onward).tolist()
    heads, k = [], 0
    while k < n:
        heads.append(k)
        k = onward[k]
    head = np.array(heads)
    return head, end[head] - at[head]


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Long factors: ``length`` words at word ``start`` of doc_id that also stand at word
    ``ref_start`` of ref_doc_id. Neighbouring factors may overlap by less than a window."""

    def finish(chunk, at, length, rdoc, rstart):
        text = np.searchsorted(chunk.words.bounds, at, side="right") - 1
        start, far = at - chunk.words.bounds[text], rstart >= FAR
        return pa.table([K.id_array(chunk.doc[text], chunk.null[text]), pa.array(start, pa.int32()), pa.array(length, pa.int32()), K.id_array(rdoc, far), pa.array(np.where(far, rstart - FAR, rstart), pa.int32())], schema=FACTORS)

    return _parsed(docs, window, finish, FACTORS)


def _kept(chunk: _Chunk, at: np.ndarray, length: np.ndarray):
    """For each document: words, words that factors cover, and the kept ones joined by a space."""
    gone = K.covered(at, length, len(chunk.words.start))
    n, removed = chunk.words.counts(), K.sums(gone, chunk.words.bounds)
    for k in range(len(chunk.doc)):
        split = chunk.texts.bytes(k).split()
        if removed[k]:
            split = compress(split, ~gone[chunk.words.bounds[k] : chunk.words.bounds[k + 1]])
        yield int(n[k]), int(removed[k]), b" ".join(split)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors of each document."""

    def finish(chunk, at, length, rdoc, rstart):
        text = np.searchsorted(chunk.words.bounds, at, side="right") - 1
        per = np.bincount(text, minlength=len(chunk.doc))
        out = [(n, r, hashlib.sha256(t).hexdigest()) for n, r, t in _kept(chunk, at, length)]
        return pa.table([K.id_array(chunk.doc, chunk.null), *(pa.array([x[k] for x in out], DIGEST[k + 1].type) for k in range(3)), pa.array(per, pa.int64())], schema=DIGEST)

    return _parsed(docs, window, finish, DIGEST)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text of the kept words joined by a space, n_removed."""

    def finish(chunk, at, length, rdoc, rstart):
        out = list(_kept(chunk, at, length))
        return pa.table([K.id_array(chunk.doc, chunk.null), pa.array([x[2].decode() for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], schema=KEPT)

    return _parsed(docs, window, finish, KEPT)
