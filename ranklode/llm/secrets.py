"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Base spans come from the three patterns below. The entropy scan adds spans of random-looking
strings: candidates are runs of the characters of a class; a window slides over each, with the
counts of its characters updated by one in and one out, and the entropy kept as a sum of
n*log2(n); windows at or above the class's threshold are merged into spans. An allow-list then
drops a span that is known to be harmless: without a digit or without a letter, at a UUID, in an
address (from "://" to a blank, quote or bracket), in a path, or in a candidate given by the
caller. A span is in a path if the pieces between separators that it touches are words and
numbers, half of their characters at least, with no other piece as long as ``PIECE``, and it
touches ``PIECES`` of them at least; the rest of its run doesn't count. Added spans that an earlier
kind's span overlaps are dropped too; base spans always stay. Offsets are code points, ends
exclusive. Every step goes through a text once, so a long text costs as much for each character as
a short one.

Null texts are empty; rows are judged one by one, so repeated rows and null ids need no
care; an empty table gives an empty result; extra columns are ignored by ``scan`` and pass
through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.session import ship

# The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# End of fixed values.
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy_hex": 3, "entropy_base64": 4}

#: Class: candidate strings, window, least bits a character.
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])"), 24, 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SEPARATORS = re.compile(r"[/_+=-]+")
#: Pieces of a path: words, with a number before or after, camel case, and numbers.
PLAIN = re.compile(r"[0-9]*(?:[A-Z]?[a-z]+|[A-Z]+|(?:[a-z]{2,})?(?:[A-Z][a-z]{2,})+)[0-9]*|[0-9]+")
#: A piece of at least so many characters that isn't plain is no part of a path, and a path has so many pieces.
PIECE, PIECES = 12, 3
ADDRESS = re.compile(r"""://[^\s"'<>()\[\]{}|\\^`]*""")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_XLOG = [0.0] + [n * math.log2(n) for n in range(1, 1025)]


def hot_windows(s: str, window: int, least: float):
    """Spans (start, end) of s whose windows have an entropy of at least ``least`` bits."""
    counts: dict[str, int] = {}
    total, limit = 0.0, (math.log2(window) - least) * window  # entropy = log2(window) - total / window
    out: list[list[int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _XLOG[n + 1] - _XLOG[n]
        if i >= window:
            d = s[i - window]
            n = counts[d]
            counts[d] = n - 1
            total += _XLOG[n - 1] - _XLOG[n]
        if i >= window - 1 and total <= limit + 1e-9:
            a = i - window + 1
            if out and a <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([a, i + 1])
    return out


class Pieces:
    """What lies between the separators of a candidate that stands at ``at``."""

    def __init__(self, s: str, at: int):
        gaps = [m.span() for m in SEPARATORS.finditer(s)]
        spans = [(a, b) for a, b in zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(s)], strict=True) if a < b]
        plain = [PLAIN.fullmatch(s, a, b) is not None for a, b in spans]
        self.start, self.end = [at + a for a, _ in spans], [at + b for _, b in spans]
        self.size = [0, *accumulate(b - a for a, b in spans)]
        self.plain = [0, *accumulate((b - a) * ok for (a, b), ok in zip(spans, plain, strict=True))]
        self.odd = [0, *accumulate(not ok and b - a >= PIECE for (a, b), ok in zip(spans, plain, strict=True))]

    def path(self, start: int, end: int) -> bool:
        i, j = bisect_right(self.end, start), bisect_left(self.start, end)
        return j - i >= PIECES and self.odd[i] == self.odd[j] and 2 * (self.plain[j] - self.plain[i]) >= self.size[j] - self.size[i]


class Spans:
    """Whether a span meets one of sorted ones."""

    def __init__(self, spans):
        self.start = [a for a, _ in spans]
        self.end = list(accumulate((b for _, b in spans), max))

    def meet(self, a: int, b: int) -> bool:
        k = bisect_left(self.start, b)
        return k > 0 and self.end[k - 1] > a


def find(text: str, allow: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Base spans and all spans: (start, order of the kind, end, kind), sorted."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    base.sort()
    every, harmless = base, None
    for kind, (pattern, window, least) in CLASSES.items():
        added, taken = [], Spans([(x[0], x[2]) for x in every])
        for m in pattern.finditer(text):
            if allow and m[0] in allow:
                continue
            pieces = None
            for a, b in hot_windows(m[0], window, least):
                a, b = a + m.start(), b + m.start()
                if taken.meet(a, b) or not DIGIT.search(text, a, b) or not LETTER.search(text, a, b):
                    continue
                if harmless is None:
                    harmless = Spans(sorted(x.span() for p in (UUID, ADDRESS) for x in p.finditer(text)))
                pieces = pieces or Pieces(m[0], m.start())
                if not harmless.meet(a, b) and not pieces.path(a, b):
                    added.append((a, ORDER[kind], b, kind))
        every = sorted(every + added)
    return base, every


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def scan(docs: DataFrame, allow: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in ("assign", "access", "hex")), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text"):
                base, every = find(text.as_py() or "", allow)
                n = [sum(x[1] == k for x in base) for k in range(3)]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in out], schema.field(k + 1).type) for k in range(5))], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str, allow: frozenset[str]) -> str:
    out, at = [], 0
    for a, _, b, _ in find(text, allow)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b  # a span that overlaps the last one belongs to its mark
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mark: str = "[SECRET]", allow: frozenset[str] = frozenset()) -> DataFrame:
    """The same rows and columns, each span of ``text`` replaced by the mark."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [None if (t := x.as_py()) is None else redacted(t, mark, allow) for x in b.column(at)]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
