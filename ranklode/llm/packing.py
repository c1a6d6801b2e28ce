"""Packing documents into sequences by minimum bin slack.

A document is its token ids and an end mark. One longer than a sequence is cut into pieces of a
whole sequence each, behind a first piece of what is left over; nothing else is cut. Only the number
of pieces of each length matters for the packing: it is counted over all pieces, so whatever the
corpus, ``CAPACITY`` numbers reach the driver. There a bitset dynamic programme over the lengths that are
left gives all sums that fit into a sequence; the fullest, of those the one with the longest
pieces, is a pattern, which is taken as often as its lengths last (that is a choice for each of so many
sequences, as long as the same combination stays the fullest). The next pattern comes from what is
left, until nothing is. The plan is made twice, once over all combinations and once over those that
hold the longest piece left (else long ones can stay behind alone), and the one with fewer sequences is taken.

Pieces of one length are alike: each gets its place among those of its length, from its place
within its input partition and the sums of the partitions before, and the patterns have the
places in order. No task holds more than its own rows, and no length's pieces meet in one.

Tokens: the tokenizers meant here (byte-level, with the usual pattern of words) never cross a place
where white space follows something else, or a mark follows a letter. Texts are cut there, and
each distinct stretch is encoded once by a worker that knows it by a 64-bit hash. A text that
holds a special token's string is encoded whole. Null and empty texts are the end mark alone. Rows with null or equal doc_ids
are documents by themselves. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklode.llm import kernels as K
from ranklode.session import cut, ship, table

CAPACITY, END = 1024, 2
#: Text that is encoded at a time, and ids of an output batch.
SLICE_BYTES, BATCH_IDS = 2 << 20, 1 << 20
#: A worker keeps the ids of at most so many stretches (some 50 MB) of at most so many bytes.
KEPT, KEPT_BYTES = 1_000_000, 48
#: A stretch of more bytes is cut further, before any mark that follows a letter.
LONG = 1 << 16
BEFORE_MARKS = re.compile(r"(?<=[^\W_])(?=[^\w\s])")
SPACE = K.byte_class((0x20, 0x20), (0x09, 0x0D))
LETTER = K.byte_class((0x41, 0x5A), (0x61, 0x7A))
MARKS = K.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def stretches(t: K.Texts) -> np.ndarray:
    """Where the stretches of some texts begin: with each text, before white space that follows
    anything else, and before an ASCII mark that follows an ASCII letter."""
    d = t.data
    space, mark = SPACE[d], MARKS[d]
    cut = np.zeros(len(d), bool)
    cut[1:] = space[1:] & ~space[:-1] | mark[1:] & LETTER[d[:-1]]
    at = np.flatnonzero(cut)
    wide = at[d[at - 1] >= 0x80]  # behind the last byte of a character that may be white space too
    wide = wide[wide >= 3]
    b3, b2, b1 = d[wide - 3], d[wide - 2], d[wide - 1]
    cut[wide[(b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 >= 0xE1) & (b3 <= 0xE3) & np.isin(b2, (0x80, 0x81, 0x9A))]] = False
    cut[1:3] &= d[: len(cut[1:3])] < 0x80
    cut[t.offsets[:-1][np.diff(t.offsets) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, as the tokenizer gives them without special tokens around."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [(t.content, k) for k, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.others = len(self.special) < len(added)
        #: Bytes of each token; of byte-level vocabularies a letter stands for a byte.
        self.width = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())], np.int64)
        self.forget()

    def forget(self) -> None:
        """Of the known stretches, by hash: how many ids each has, and where in the pool."""
        self.hash, self.count, self.first, self.pool = np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def joined(self, text: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """How many ids each stretch has, and the ids, if they are one text whose tokens keep to
        the bounds of the stretches."""
        ids = np.array(self.plain(text.decode("utf-8", "replace")), np.uint32)
        ends, want = np.cumsum(self.width[ids]), np.cumsum(size)
        at = np.searchsorted(ends, want)
        if not len(ends) or at.max(initial=0) >= len(ends) or (ends[at] != want).any() or ends[-1] != want[-1]:
            return None
        return np.diff(np.r_[-1, at]), ids

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``joined``, for any texts: a special token's string between two keeps them apart."""
        if not self.special:
            got = [self.plain(t) for t in texts]
            return np.array([len(x) for x in got], np.int64), np.array([y for x in got for y in x], np.uint32)
        between, mark = self.special[0]
        ids = np.array(self.plain(between.join(texts)), np.uint32)
        ends = np.r_[np.flatnonzero(ids == mark), len(ids)]
        return np.diff(np.r_[-1, ends]) - 1, ids[ids != mark]

    def learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these stretches has, and where they begin in the ``pool`` now."""
        count, first = np.zeros((2, len(start)), np.int64)

        def put(rows, n, ids):
            count[rows], first[rows] = n, len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, ids])

        text = lambda k: data[start[k] : start[k] + size[k]].tobytes().decode("utf-8", "replace")
        long = size > LONG
        last = data[start + size - 1]
        plain = np.flatnonzero(SPACE[data[start]] & (LETTER[last] | MARKS[last]) & ~long)  # may follow each other
        got = self.joined(data[K.ranges(start[plain], size[plain])].tobytes(), size[plain]) if len(plain) else None
        if got:
            put(plain, *got)
        else:
            plain = plain[:0]
        rest = np.setdiff1d(np.flatnonzero(~long), plain)
        if len(rest):
            put(rest, *self.apart([text(k) for k in rest]))
        for k in np.flatnonzero(long):
            ids = np.array([i for part in BEFORE_MARKS.split(text(k)) for i in self.plain(part)], np.uint32)
            put([k], np.array([len(ids)]), ids)
        return count, first

    def __call__(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """ids, and their bounds for each text."""
        whole = t.data.tobytes()
        if self.others or any(s.encode() in whole for s, _ in self.special):  # rare: text by text
            got = []
            for k in range(len(t)):
                one = t.bytes(k)
                alone = self.others or any(s.encode() in one for s, _ in self.special)
                got.append(np.array(self.plain(one.decode("utf-8", "replace")), np.uint32) if alone else self.stretched(K.Texts(np.frombuffer(one, np.uint8), np.array([0, len(one)])))[0])
            return np.concatenate(got), np.cumsum([0, *map(len, got)])
        return self.stretched(t)

    def stretched(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        if not len(t.data):
            return np.zeros(0, np.uint32), np.zeros(len(t.offsets), np.int64)
        start = stretches(t)
        size = np.diff(np.r_[start, len(t.data)])
        h = K.span_hashes(t.data, start, start + size)
        at = np.searchsorted(self.hash, h)
        known = np.r_[self.hash, K.U64(0)][at] == h
        known &= at < len(self.hash)
        new = np.flatnonzero(~known)
        count, first = (np.r_[x, 0][at] for x in (self.count, self.first))
        if len(new):
            fresh, some, which = np.unique(h[new], return_index=True, return_inverse=True)
            some = new[some]
            n, begin = self.learn(t.data, start[some], size[some])
            count[new], first[new] = n[which], begin[which]
            short = size[some] <= KEPT_BYTES
            place = np.searchsorted(self.hash, fresh[short])
            self.hash, self.count, self.first = (np.insert(x, place, y[short]) for x, y in ((self.hash, fresh), (self.count, n), (self.first, begin)))
        ids = self.pool[K.ranges(first, count)]
        bounds = np.r_[0, np.cumsum(count)][np.searchsorted(start, t.offsets)]
        if len(self.hash) > KEPT or len(self.pool) > 8 * KEPT:
            self.forget()
        return ids, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "part int, place int, doc_id long, piece int, start long, length int, ids binary"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """part (input partition), place (from 0 among the part's pieces of this length), doc_id, piece,
    start, length, ids (little-endian unsigned 32-bit) of all documents' pieces."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        task, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc, null = K.ids(b.column("doc_id"))
            t = K.texts(b.column("text"))
            for i, j in K.slices(t.offsets, SLICE_BYTES):
                a = t.offsets[i]
                ids, bounds = encode(K.Texts(t.data[a : t.offsets[j]], t.offsets[i : j + 1] - a))
                ids = np.insert(ids, bounds[1:], end)
                size = np.diff(bounds) + 1
                n = -(-size // capacity)
                who = np.repeat(np.arange(j - i), n)
                piece = K.ranges(np.zeros(j - i, np.int64), n)
                first = ((size - 1) % capacity + 1)[who]  # what is left over, or a whole sequence
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                order = np.argsort(length, kind="stable")
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order]) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                at = np.r_[0, np.cumsum(length)]
                for p in range(0, len(length), BATCH_IDS // capacity):
                    q = min(p + BATCH_IDS // capacity, len(length))
                    data = np.ascontiguousarray(ids[at[p] : at[q]]).astype("<u4").tobytes()
                    load = pa.Array.from_buffers(pa.binary(), q - p, [None, pa.py_buffer((4 * (at[p : q + 1] - at[p])).astype(np.int32)), pa.py_buffer(data)])
                    columns = [pa.array(np.full(q - p, task), pa.int32()), pa.array(place[p:q], pa.int32()), K.id_array(doc[i:j][who[p:q]], null[i:j][who[p:q]]), pa.array(piece[p:q], pa.int32()), pa.array(start[p:q]), pa.array(length[p:q], pa.int32()), load]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def patterns(count: np.ndarray, capacity: int = CAPACITY, seeded: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many in a sequence)], longest first) that take ``count[length]``
    pieces of each length together. ``seeded``: each is the fullest with the longest piece left."""
    left = [int(x) for x in count]
    lengths = [k for k in range(1, capacity + 1) if left[k]]
    mask = (1 << capacity + 1) - 1
    sums = [1]  # sums[i]: which sums the first i lengths can make, a bit each
    copies: list[int] = []  # how many of each length they were made with
    out = []
    while lengths:
        for length in lengths[len(copies) : -1]:
            reach, most, step = sums[-1], min(left[length], capacity // length), 1
            copies.append(most)
            while most:
                take = min(step, most)
                reach |= reach << take * length & mask
                most, step = most - take, step * 2
            sums.append(reach)
        longest, last = lengths[-1], len(lengths) - 1
        fill = lambda k: k * longest + (sums[last] & (2 << capacity - k * longest) - 1).bit_length() - 1  # noqa: B023, E731
        k = max(range(int(seeded), min(left[longest], capacity // longest) + 1), key=lambda k: (fill(k), k))
        total, pattern = fill(k) - k * longest, [(longest, k)] if k else []
        for i in range(last - 1, -1, -1):
            if not total:
                break
            length = lengths[i]
            if length <= total:
                k = next(k for k in range(min(copies[i], total // length), -1, -1) if sums[i] >> total - k * length & 1)
                if k:
                    pattern.append((length, k))
                    total -= k * length
        times = min(left[length] // k for length, k in pattern)
        out.append((times, pattern))
        for length, k in pattern:
            left[length] -= times * k
        # What the lengths below the least changed one can make stays.
        keep = next((i for i, (x, n) in enumerate(zip(lengths, copies, strict=False)) if min(left[x], capacity // x) != n), len(copies))
        lengths = [x for x in lengths if left[x]]
        keep = min(keep, max(len(lengths) - 1, 0))
        del sums[keep + 1 :], copies[keep:]
    return out


def fewest(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """The patterns of the way, with or without the longest piece in each, that needs fewer sequences."""
    return min((patterns(count, capacity, seeded) for seeded in (True, False)), key=lambda found: sum(times for times, _ in found))


def _plan(found: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each length: where its runs of places begin, and for each run the first sequence, the
    pieces a sequence, and the offset of the first of them there."""
    begins, runs = ([[] for _ in range(capacity + 1)] for _ in range(2))
    used, sequence = [0] * (capacity + 1), 0
    for times, pattern in found:
        offset = 0
        for length, k in pattern:
            begins[length].append(used[length])
            runs[length].append((sequence, k, offset))
            used[length] += times * k
            offset += k * length
        sequence += times
    return [np.array(x, np.int64) for x in begins], [np.array(x, np.int64).reshape(-1, 3) for x in runs]


def placed(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A written table of pieces (part, place, length and other columns) with sequence_id and
    offset instead of part and place."""
    per = cut(cut_up.groupBy("length", "part").agg(F.count("*").alias("_n")), "lengths")
    count = np.zeros(capacity + 1, np.int64)
    for length, n in per.groupBy("length").agg(F.sum("_n")).collect():  # at most ``capacity`` rows
        count[length] = n
    begins, runs = _plan(fewest(count, capacity), capacity)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("length", "part", F.coalesce(before, F.lit(0)).alias("_before"))
    keep = [c for c in cut_up.columns if c not in ("part", "place")]
    rows = cut_up.join(per, ["length", "part"]).select(*keep, (F.col("_before") + F.col("place")).alias("_place"))

    def run(batches):
        for b in batches:
            length, place = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_place"))
            sequence, offset = np.zeros((2, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[at[0]])
                k = np.searchsorted(begins[size], place[at], side="right") - 1
                first, each, start = runs[size][k].T
                past = place[at] - begins[size][k]
                sequence[at], offset[at] = first + past // each, start + past % each * size
            columns = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_place")
    return rows.mapInArrow(run, f"{out}, sequence_id long, offset long")


def packed(docs: DataFrame, **how) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of each piece."""
    return placed(cut(pieces(docs, **how), "pieces"), how.get("capacity", CAPACITY))


def sequences(docs: DataFrame, **how) -> DataFrame:
    """sequence_id and ids (little-endian unsigned 32-bit) of each sequence."""
    rows = packed(docs, **how).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return rows.select("sequence_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: only the checksums of the ids
    are written on the way."""
    rows = pieces(docs, **how).select("part", "place", "doc_id", "piece", "start", F.col("length"), F.crc32("ids").alias("ids_crc32"))
    out = placed(cut(rows, "pieces"), how.get("capacity", CAPACITY))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
