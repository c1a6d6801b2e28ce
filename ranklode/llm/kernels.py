"""Vectorised text kernels: words of UTF-8 texts, their hashes, hashes of word runs.

Everything works on the bytes of an Arrow string column. The separators of all
contracts are ASCII, so bytes and code points split alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPLIT_BYTES = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the given inclusive byte ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words of [^\x20\x09-\x0D]+.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+: digits, a-z and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
GRAM1, GRAM2 = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_pow = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits in which each input bit moves each output bit."""
    x = x + U64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Texts:
    """Bytes of some texts, back to back: text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, off - off[0])


@dataclass
class Words:
    """Words of texts in order: byte spans, hash, and words[bounds[i]:bounds[i+1]] of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def _words(t: Texts, inside: np.ndarray, hashed: bool) -> Words:
    n = len(t.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(U64) if hashed else None, np.zeros(len(t.offsets), np.int64))
    w = inside[t.data]
    cuts = t.offsets[(t.offsets > 0) & (t.offsets < n)]
    first = w.copy()
    first[1:] &= ~w[:-1]
    first[cuts] |= w[cuts]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cuts - 1] |= w[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = None
    if hashed:
        h = span_hashes(t.data, start, end)
    return Words(start, end, h, np.searchsorted(start, t.offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, by the bytes and their number."""
    p, inv = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(U64))


def slices(offsets: np.ndarray, limit: int = SPLIT_BYTES):
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(t: Texts, inside: np.ndarray = SPACED, lower: bool = False, hashed: bool = True) -> Words:
    """In pieces that stay in the processor's cache."""
    parts, at = [], 0
    bounds = [np.zeros(1, np.int64)]
    for i, j in slices(t.offsets):
        a, b = t.offsets[i], t.offsets[j]
        data = t.data[a:b]
        w = _words(Texts(LOWER[data] if lower else data, t.offsets[i : j + 1] - a), inside, hashed)
        parts.append((w.start + a, w.end + a, w.hash))
        bounds.append(w.bounds[1:] + at)
        at += len(w.start)
    if not parts:
        return _words(t, inside, hashed)
    cat = lambda k: parts[0][k] if len(parts) == 1 else np.concatenate([x[k] for x in parts])
    return Words(cat(0), cat(1), cat(2) if hashed else None, np.concatenate(bounds))


def grams(h: np.ndarray, k: int, base: np.uint64 = GRAM1) -> np.ndarray:
    """Hash of each run of k values (not mixed); runs cross text bounds, see ``whole``."""
    if len(h) < k:
        return np.zeros(0, U64)
    run, have, part, size, left = None, 0, h, 1, k
    while True:
        if left & 1:
            factor = U64(pow(int(base), size, 1 << 64))
            if run is None:
                run = part
            else:
                n = len(h) - have - size + 1
                run = run[:n] * factor + part[have : have + n]
            have += size
        left >>= 1
        if not left:
            return run
        factor = U64(pow(int(base), size, 1 << 64))
        part = part[:-size] * factor + part[size:]
        size *= 2


def whole(bounds: np.ndarray, k: int) -> np.ndarray:
    """Indices of words at which a run of k words of one text starts."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    return ranges(bounds[:-1], counts)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    if len(x) < w:
        return x[:0]
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : len(x) - size + 1])


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]]."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def join_blobs(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


NO_ID = (1 << 63) - 1


def ids(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row ids as int64, and which of them are null: those hold NO_ID, which a row may have as well."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)


def id_array(x: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int64(), mask=null)
