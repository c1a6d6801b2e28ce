"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: a shard is some documents whose texts add up to a few MB,
and its row holds, for every term, the ascending positions of its postings (a position counts
the words of the shard). It knows nothing of any benchmark: it is written once and searched as
often as needed, without the corpus. The test items are written to the shared folder too, as blocks
of bounded size; a task that searches some shards reads the blocks one after the other, so neither
the driver nor a task ever holds the benchmark. A shard looks up each distinct word of a block once,
which leaves the windows all of whose words it has; each distinct window is searched once,
however many items repeat it. It starts from the term with the fewest postings in the shard, shifts that list by
the term's offset, and intersects it with the shifted lists of the other terms, rarest first;
some windows advance together, of no more postings than ``SLICE_SEEDS`` at a time, so that one word
said over and over takes no more memory than any text. What is left are exact phrase matches. Proximity matches relax
the offsets to a distance. No text is shuffled and no key is gathered, so common terms, shared
passages and large groups of copies only cost the shard they are in.

Null texts and items have no words; an item without words has no window and never matches; a
shorter item than a window is one window by itself. Items that repeat, or share an item_id,
count once by their item_id; a null item_id matches words but is no item in the list. Rows
with null or equal doc_ids are judged one by one. Empty tables give empty results, and
without items nothing is hit. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.llm import kernels as K
from ranklode.llm import store
from ranklode.session import cut, shared_dir, ship

WINDOW = 10
SHARD_BYTES = 2 << 20
#: A block of test items has at most so many words (some 30 MB with its windows), or one item.
BLOCK_WORDS = 400_000
#: Text of the shards, or rows, that a task searches while it reads the blocks once.
TAKE_BYTES = 48 << 20
#: Windows and seeds that are followed at a time.
SLICE_WINDOWS, SLICE_SEEDS = 1 << 15, 1 << 20
INDEX = pa.schema([(k, pa.binary()) for k in ("doc_ids", "nulls", "bounds", "terms", "counts", "positions")])
INDEX_DDL = "doc_ids binary, nulls binary, bounds binary, terms binary, counts binary, positions binary"
BLOCKS = pa.schema([("names", pa.list_(pa.string())), ("bounds", pa.binary()), ("terms", pa.binary())])
BLOCKS_DDL = "names array<string>, bounds binary, terms binary"
HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _shards(batches):
    """Document batches as (ids, which are null, texts) of about SHARD_BYTES."""
    ids, nulls, parts, size = [], [], [], 0
    for b in batches:
        t = K.texts(b.column("text"))
        doc, null = K.ids(b.column("doc_id"))
        for i, j in K.slices(t.offsets, SHARD_BYTES):
            a = t.offsets[i]
            part = K.Texts(t.data[a : t.offsets[j]], t.offsets[i : j + 1] - a)
            ids.append(doc[i:j])
            nulls.append(null[i:j])
            parts.append(part)
            size += len(part.data)
            if size >= SHARD_BYTES:
                yield np.concatenate(ids), np.concatenate(nulls), _joined(parts)
                ids, nulls, parts, size = [], [], [], 0
    if parts:
        yield np.concatenate(ids), np.concatenate(nulls), _joined(parts)


def _joined(parts: list[K.Texts]) -> K.Texts:
    if len(parts) == 1:
        return parts[0]
    at = np.cumsum([0, *(len(p.data) for p in parts)])
    return K.Texts(np.concatenate([p.data for p in parts]), np.concatenate([[0], *(p.offsets[1:] + a for p, a in zip(parts, at[:-1], strict=True))]))


def _postings(ids: np.ndarray, nulls: np.ndarray, t: K.Texts) -> dict[str, bytes]:
    """The row of a shard."""
    w = K.words(t, K.ALNUM, lower=True)
    order = np.argsort(w.hash, kind="stable").astype(np.int32)
    h = w.hash[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    columns = (ids, nulls, w.bounds, h[head], np.diff(np.r_[head, len(h)]).astype(np.int32), order)
    return dict(zip(INDEX.names, map(K.blob, columns), strict=True))


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each shard: doc_ids, nulls (rows without id), bounds (first position of each document, and the end),
    terms (ascending hashes), counts and positions (of the first term, then the second, ...)."""
    ship(docs.sparkSession)

    def build(batches):
        for shard in _shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _postings(*shard).values()], schema=INDEX)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX_DDL)


class Shard:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.terms = np.frombuffer(row["terms"], K.U64)
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32)
        self.first = np.cumsum(self.counts) - self.counts
        self._keys = None

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Ranks of terms in this shard, -1 where it has none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether a term has a posting at a position: one look into its list."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), self.counts) << 32 | self.positions
        key = rank.astype(np.int64) << 32 | position
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return self._keys[at] == key

    def _slices(self, test: Items):
        """Windows all of whose terms are here, in slices of bounded numbers of windows and seeds:
        (windows, their terms' ranks, places of their terms from rarest to most common, which
        window each seed is of, and its position)."""
        rank = self.ranks(test.vocabulary)[test.words]
        have = np.r_[0, np.cumsum(rank >= 0)]
        every = np.flatnonzero(have[test.start + test.size] - have[test.start] == test.size)
        width = np.arange(test.window)
        for at in range(0, len(every), SLICE_WINDOWS):
            win = every[at : at + SLICE_WINDOWS]
            size = test.size[win][:, None]
            ranks = rank[test.start[win][:, None] + np.minimum(width, size - 1)]
            df = np.where(width < size, self.counts[ranks], 1 << 40)
            order = np.argsort(df, axis=1, kind="stable")
            rare = np.take_along_axis(ranks, order[:, :1], axis=1)[:, 0]
            upto = np.cumsum(self.counts[rare])
            i = 0
            while i < len(win):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE_SEEDS, side="right")))
                count = self.counts[rare[i:j]]
                place = self.positions[K.ranges(self.first[rare[i:j]], count)].astype(np.int64)
                yield win[i:j], ranks[i:j], order[i:j], np.repeat(np.arange(j - i), count), place
                i = j

    def phrases(self, test: Items):
        """(window, position) of each exact occurrence within one document, slice by slice."""
        for win, ranks, order, who, place in self._slices(test):
            start = place - order[who, 0]
            text = np.searchsorted(self.bounds, place, side="right") - 1
            ok = (start >= self.bounds[text]) & (start + test.size[win[who]] <= self.bounds[text + 1])
            who, start = who[ok], start[ok]
            for k in range(1, test.window):
                if not len(who):
                    break
                todo = k < test.size[win[who]]
                at = order[who, k]
                keep = ~todo
                keep[todo] = self.has(ranks[who[todo], at[todo]], start[todo] + at[todo])
                who, start = who[keep], start[keep]
            if len(who):
                yield win[who], start

    def close(self, test: Items, distance: int):
        """(window, position of its rarest term) where all its terms come within ``distance``
        words of that position, in one document."""
        for win, ranks, order, who, place in self._slices(test):
            keep = np.ones(len(who), bool)
            text = np.searchsorted(self.bounds, place, side="right") - 1
            for k in range(1, test.window):
                todo = np.flatnonzero(keep & (k < test.size[win[who]]))
                if not len(todo):
                    break
                rank = ranks[who[todo], order[who[todo], k]]
                lo = np.maximum(place[todo] - distance, self.bounds[text[todo]])
                hi = np.minimum(place[todo] + distance, self.bounds[text[todo] + 1] - 1)
                self.has(rank[:1], lo[:1])
                base = rank.astype(np.int64) << 32
                keep[todo] = np.searchsorted(self._keys, base | hi, side="right") > np.searchsorted(self._keys, base | lo)
            if keep.any():
                yield win[who[keep]], place[keep]


class Items:
    """The distinct windows of a block of test items, and which items have each. A window is some
    places of the block's words; a shard looks up each distinct word of the block once."""

    def __init__(self, names: list, bounds: np.ndarray, terms: np.ndarray, window: int):
        self.names, self.window = names, window
        self.vocabulary, self.words = np.unique(terms, return_inverse=True)
        n = np.diff(bounds)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        item, start = np.repeat(np.arange(len(n)), count), K.ranges(bounds[:-1], count)
        size = size[item]
        key = np.zeros((len(start), 2), K.U64)
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            for side, base in enumerate((K.GRAM1, K.GRAM2)):
                key[at, side] = K.mix(K.grams(terms, int(length), base), int(length))[start[at]]
        order = np.lexsort((item, key[:, 1], key[:, 0]))
        key, item = key[order], item[order]
        head = np.ones(len(order), bool)
        head[1:] = (key[1:] != key[:-1]).any(1)
        self.start, self.size = start[order][head], size[order][head]
        # Of window w: owners[first[w]:first[w + 1]], each item once.
        which = np.cumsum(head) - 1
        once = head.copy()
        once[1:] |= item[1:] != item[:-1]
        self.owners, self.first = item[once], np.searchsorted(which[once], np.arange(len(self.start) + 1))

    def items_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the windows, item) of each."""
        count = self.first[windows + 1] - self.first[windows]
        return np.repeat(np.arange(len(windows)), count), self.owners[K.ranges(self.first[windows], count)]


def _pieces(batches):
    """Rows of BLOCKS from items."""

    def row(names, counts, terms):
        bounds = np.cumsum([0, *counts])
        return pa.RecordBatch.from_arrays([pa.array([names], BLOCKS.field(0).type), *(pa.array([K.blob(x)], pa.binary()) for x in (bounds, np.concatenate(terms)))], schema=BLOCKS)

    names, counts, terms = [], [], []
    for b in batches:
        ids = b.column("item_id").to_pylist()
        w = K.words(K.texts(b.column("text")), K.ALNUM, lower=True)
        for k, n in enumerate(w.counts().tolist()):
            if names and sum(counts) + n > BLOCK_WORDS:
                yield row(names, counts, terms)
                names, counts, terms = [], [], []
            names.append(ids[k])
            counts.append(n)
            terms.append(w.hash[w.bounds[k] : w.bounds[k + 1]])
    if names:
        yield row(names, counts, terms)


def write_items(items: DataFrame) -> str:
    """The folder to which the test items are written as blocks."""
    spark = items.sparkSession
    ship(spark)
    path = shared_dir(spark, "items")
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_pieces, BLOCKS_DDL).write.option("parquet.block.size", str(32 << 20)).parquet(path)
    return path


def _read(path: str, window: int):
    for f in store.place(path).files():
        if f.endswith(".parquet"):
            with store.open_file(path, f) as stream:
                for b in pq.ParquetFile(stream).iter_batches(batch_size=1):
                    for r in b.to_pylist():
                        yield Items(r["names"], np.frombuffer(r["bounds"], np.int64), np.frombuffer(r["terms"], K.U64), window)


@lru_cache(maxsize=1)
def _first_two(path: str, window: int) -> list[Items]:
    got = _read(path, window)
    return [x for x, _ in zip(got, range(2), strict=False)]


def _blocks(path: str, window: int):
    """The blocks of items one by one; a worker keeps them if they are few."""
    few = _first_two(path, window)
    yield from few if len(few) < 2 else _read(path, window)


def _taken(batches):
    """Shards in lists of about TAKE_BYTES of text (six bytes a word)."""
    shards, size = [], 0
    for b in batches:
        for row in b.to_pylist():
            shards.append(Shard(row))
            size += 6 * len(shards[-1].positions)
            if size >= TAKE_BYTES:
                yield shards
                shards, size = [], 0
    if shards:
        yield shards


def _judged(shards: list[Shard], blocks):
    """Rows of HITS of some shards, after one pass over the blocks."""
    hits = [np.zeros(int(s.bounds[-1]) + 1, np.int64) for s in shards]
    found: list[list[set[str]]] = [[set() for _ in s.ids] for s in shards]
    for test in blocks:
        for shard, hit, names in zip(shards, hits, found, strict=True):
            for win, start in shard.phrases(test):
                hit += np.bincount(start, minlength=len(hit)) - np.bincount(start + test.size[win], minlength=len(hit))
                doc, w = np.unique(np.stack([np.searchsorted(shard.bounds, start, side="right") - 1, win]), axis=1)
                at, item = test.items_of(w)
                for d, i in np.unique(np.stack([doc[at], item]), axis=1).T.tolist():
                    if test.names[i] is not None:
                        names[d].add(test.names[i])
    none = hashlib.sha256(b"").hexdigest()
    for shard, hit, names in zip(shards, hits, found, strict=True):
        n_hit = K.sums(np.cumsum(hit)[:-1] > 0, shard.bounds)
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else none for x in names]
        yield pa.RecordBatch.from_arrays(
            [K.id_array(shard.ids, shard.nulls), pa.array(np.diff(shard.bounds)), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0)],
            schema=HITS,
        )


def search(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each indexed document."""
    path = write_items(items)

    def look(batches):
        for shards in _taken(batches):
            yield from _judged(shards, _blocks(path, window))

    return index.mapInArrow(look, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def proximity(index: DataFrame, items: DataFrame, distance: int, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, position: windows of items whose words all come, in any order, within
    ``distance`` words of their rarest one (its position in the document)."""
    path = write_items(items)

    def look(batches):
        for shards in _taken(batches):
            for test in _blocks(path, window):
                for shard in shards:
                    for win, place in shard.close(test, distance):
                        at, item = test.items_of(win)
                        place = place[at]
                        text = np.searchsorted(shard.bounds, place, side="right") - 1
                        got = np.unique(np.stack([text, item, place - shard.bounds[text]]), axis=1)
                        yield pa.RecordBatch.from_arrays([K.id_array(shard.ids[got[0]], shard.nulls[got[0]]), pa.array([test.names[i] for i in got[1].tolist()], pa.string()), pa.array(got[2], pa.int64())], names=["doc_id", "item_id", "position"])

    return index.mapInArrow(look, "doc_id long, item_id string, position long").distinct()


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """As ``search``, over an index that is written to the shared folder first."""
    return search(cut(build_index(docs), "index"), items, window)


def drop(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a window. Rows that share a doc_id go together."""
    bad = judged(docs, items, window).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows without any occurrence of a window, each judged by itself, whatever its doc_id.
    The rows of a batch are indexed where they are and go on with the verdict."""
    path = write_items(items)
    at = docs.columns.index("text")

    def run(batches):
        for some in _gathered(batches, at):
            yield from _kept(some, at, _blocks(path, window))

    return docs.mapInArrow(run, docs.schema)


def _gathered(batches, at: int):
    """Batches in lists of about TAKE_BYTES of the text column."""
    some, size = [], 0
    for b in batches:
        some.append(b)
        size += b.column(at).nbytes
        if size >= TAKE_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _kept(some: list[pa.RecordBatch], at: int, blocks):
    """The batches without the rows that a window occurs in, after one pass over the blocks."""
    keep = [np.ones(b.num_rows, bool) for b in some]
    shards = []
    for b, kept in zip(some, keep, strict=True):
        t = K.texts(b.column(at).cast(pa.string()))
        for i, j in K.slices(t.offsets, SHARD_BYTES):
            a = t.offsets[i]
            shards.append((kept[i:j], Shard(_postings(np.arange(i, j), np.zeros(j - i, bool), K.Texts(t.data[a : t.offsets[j]], t.offsets[i : j + 1] - a)))))
    for test in blocks:
        for kept, shard in shards:
            for _, start in shard.phrases(test):
                kept[np.searchsorted(shard.bounds, start, side="right") - 1] = False
    for b, kept in zip(some, keep, strict=True):
        yield b.filter(pa.array(kept))
