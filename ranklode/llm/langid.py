"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone. A trigram is
bound from its letters' vectors, the first permuted twice and the second once, by elementwise
product; word ends count as a letter. A document's vector is the bundle (sum) of its trigrams'
vectors and a language's prototype the bundle of its documents' unit vectors. The prediction
is the prototype of greatest cosine; the mean of all prototypes is taken off first, as what all
languages share says nothing.

Texts that are null or hold no letter are ``und`` with score 0 (a learned language of that name
can only be told from it by the score). Ties, cosines that differ by less than ``TIE``, go to the language first
by code point. Labels that are null teach nothing; with no labelled text at all every prediction
is ``und``. Every labelled document is learned from, in sums of one vector for each language and
task, which are added in two steps: no task adds more than some ``PARTS``-th of them. Rows are judged one by one, so repeats and null ids need no care; a null doc_id counts as
the text "null" for the split. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.llm import kernels as K
from ranklode.session import ship

DIMENSION = 1024
SLICE = 256 << 10
#: Trigrams whose vectors and counts are held at once: some 20 MB beside their keys.
BLOCK = 2048
#: Prototypes are held on the driver and in each task: at most so many languages (4 MB).
MOST_LANGUAGES = 1000
END = 0x20
#: Cosines are sums of floats: so near they count as equal.
TIE = 1e-6
#: Into so many parts the sums of a language are dealt before they meet.
PARTS = 1000


@lru_cache(maxsize=1 << 16)
def letter(code: int, dimension: int = DIMENSION) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, dimension, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigram_vectors(keys: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """One row for each key (three code points of 21 bits)."""
    parts = [(keys >> np.uint64(s)).astype(np.int64) & 0x1FFFFF for s in (42, 21, 0)]
    codes, at = np.unique(np.concatenate(parts), return_inverse=True)
    table = np.stack([letter(int(c), dimension) for c in codes]) if len(codes) else np.zeros((0, dimension), np.int8)
    a, b, c = np.split(at, 3)
    return (np.roll(table, 2, 1)[a] * np.roll(table, 1, 1)[b] * table[c]).astype(np.float32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, or 0."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0])
    return out


def _trigrams(text: str) -> np.ndarray:
    """Keys of all trigrams of letters and word ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(codes < 0x10000, _letters()[np.minimum(codes, 0xFFFF)], 0)
    far = np.flatnonzero(codes >= 0x10000)
    for i in far:
        if chr(codes[i]).isalpha():
            low[i] = ord(chr(codes[i]).lower()[0])
    if not low.any():
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(low) + 2, np.uint64)
    padded[1:-1] = low
    padded = padded[np.r_[True, (padded[1:] != 0) | (padded[:-1] != 0)]]  # one end between words
    padded[padded == 0] = END
    if padded[-1] != END:
        padded = np.r_[padded, np.uint64(END)]
    key = padded[:-2] << np.uint64(42) | padded[1:-1] << np.uint64(21) | padded[2:]
    return key[padded[1:-1] != END]  # not centred on a gap


def bundles(texts: list[str | None], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors, a row for each text; zero without letters."""
    out = np.zeros((len(texts), dimension), np.float32)
    keys = [_trigrams(t) if t else np.zeros(0, np.uint64) for t in texts]
    n = np.array([len(k) for k in keys])
    if n.sum():
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        # (trigram, text) pairs with their counts, by trigram
        pair, times = np.unique(at.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), n), return_counts=True)
        gram, text = np.divmod(pair, len(texts))
        for a in range(0, len(unique), BLOCK):  # bounded memory, however many different trigrams
            i, j = np.searchsorted(gram, (a, a + BLOCK))
            counts = np.zeros((len(texts), min(BLOCK, len(unique) - a)), np.float32)
            counts[text[i:j], gram[i:j] - a] = times[i:j]
            out += counts @ trigram_vectors(unique[a : a + BLOCK], dimension)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        np.divide(out, norm, out=out, where=norm > 0)
    return out


def _slices(texts: list[str | None]):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or k - at >= 255:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def train(labelled: DataFrame, dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """Prototypes by language from (text, lang)."""
    ship(labelled.sparkSession)

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for i, j in _slices(texts):
                v = bundles(texts[i:j], dimension)
                for lang in set(langs[i:j]):
                    rows = [k for k, x in enumerate(langs[i:j]) if x == lang]
                    total.setdefault(lang, np.zeros(dimension))
                    total[lang] += v[rows].sum(0, dtype=np.float64)
        langs = sorted(total)
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([part] * len(langs), pa.int32()), pa.array([K.blob(total[x]) for x in langs], pa.binary())], names=["lang", "part", "v"])

    def add(key, table):
        v = np.sum([np.frombuffer(x, np.float64) for x in table.column("v").to_pylist()], axis=0)
        return pa.table([pa.array([key[0].as_py()]), pa.array([K.blob(v)], pa.binary())], names=["lang", "v"])

    narrow = labelled.filter("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = narrow.mapInArrow(sums, "lang string, part int, v binary").groupBy("lang", "part").applyInArrow(add, "lang string, v binary").groupBy("lang").applyInArrow(add, "lang string, v binary").limit(MOST_LANGUAGES + 1).toArrow()
    if got.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {k: np.frombuffer(v, np.float64) for k, v in zip(got.column("lang").to_pylist(), got.column("v").to_pylist(), strict=True)}
    out = {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *carry: str) -> DataFrame:
    """``carry`` columns, lang_pred and score (the cosine, from 0 to 1) of each row's text."""
    spark = docs.sparkSession
    ship(spark)
    names = list(prototypes)
    table = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIMENSION))
    mean = table.mean(0) if len(names) > 1 else np.zeros(table.shape[1])
    centred = (table - mean).astype(np.float32)
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast((names, centred, mean.astype(np.float32)))

    def run(batches):
        names, centred, mean = shared.value
        for b in batches:
            texts = b.column("_text").to_pylist()
            lang, score = [], []
            for i, j in _slices(texts):
                v = bundles(texts[i:j], centred.shape[1])
                some = v.any(1) & bool(names)
                v = v - mean
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                cos = v @ centred.T if names else np.zeros((j - i, 1))
                best = (cos >= cos.max(1, keepdims=True) - TIE).argmax(1)
                lang += [names[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                score += np.where(some, np.clip(cos[np.arange(j - i), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*carry, "lang_pred", "score"])

    ddl = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(run, ddl + "lang_pred string, score double")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(3)) == 1


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that aren't held out."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out().alias("held_out"))
    prototypes = train(narrow.filter(~F.col("held_out")))
    return predict(narrow.select("doc_id", "held_out", "text"), prototypes, "doc_id", "held_out")
