"""Parsers of whole texts: stems, lemmas and sub-words, HTML documents, question records.

Stems and records are expressions. Lemmas and sub-words come from functions or model files that
the caller names; they run over Arrow batches, loaded once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.functions.html import page as parsed_page
from ranklode.functions.stem import stems
from ranklode.functions.text import col

#: Suffix rules of the light stemmer, in order, over a text of a-z, 0-9 and single blanks.
STEMS = [
    (r"\b([a-z0-9]{2,})(?:ies|ied)\b", "$1y"),
    (r"\b([a-z0-9]*(?:ss|sh|ch|x|zz))es\b", "$1"),
    (r"\b([a-z0-9]{2,}[^sui ])s\b", "$1"),
    *((rf"\b([a-z0-9]*[aeiouy][a-z0-9]*{c}){c}(?:ed|ing)\b", "$1") for c in "bdgmnprt"),
    (r"\b([a-z0-9]*[aeiouy][a-z0-9]+)(?:ed|ing)\b", "$1"),
]


def clean_latin(c) -> Column:
    """Lower case, only a-z and 0-9, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def without(c, stop: list[str]) -> Column:
    """Words of a text of single blanks that aren't listed."""
    words = F.split(col(c), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words, " ")


def stemmed(c, stop: list[str] = ()) -> Column:
    """The stems of a text's words; stop words go before. A light stemmer: plurals, past tenses and
    participles lose their endings, nothing else."""
    x = without(clean_latin(c), [w.lower() for w in stop])
    for pattern, by in STEMS:
        x = F.regexp_replace(x, pattern, by)
    return x


def porter_stemmed(c, stop: list[str] = ()) -> Column:
    """The stems of a text's words by Porter's steps; stop words go before."""
    return F.array_join(stems(F.split(without(clean_latin(c), [w.lower() for w in stop]), " ")), " ")


LEMMATIZERS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def lemmatizer(name: str):
    """Register a factory: called once a task, it gives the function from tokens to lemmas."""

    def add(factory):
        LEMMATIZERS[name] = factory
        return factory

    return add


@lemmatizer("same")
def _same():
    return lambda tokens: tokens


def parsed(c, name: str = "same", stop: list[str] = (), alphanumeric: bool = False, lower: bool = True) -> Column:
    """A struct of ``lemmas`` and ``tokens``, words joined by blanks. Punctuation goes, and tokens
    that are stop words or whose lemma is one; on demand all that isn't alphanumeric."""
    import re

    factory, drop = LEMMATIZERS[name], frozenset(w.lower() for w in stop)
    token, word = re.compile(r"\w+(?:[-_.']\w+)*|[^\w\s]"), re.compile(r"[\w.\-]+")

    @F.pandas_udf("lemmas string, tokens string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lemmas_of = factory()
        for texts in batches:
            out = []
            for t in texts:
                tokens = [x for x in token.findall((t or "").replace("’", "'")) if x[0].isalnum() or x[0] == "_"]
                if alphanumeric:
                    tokens = [x for x in tokens if word.fullmatch(x)]
                pairs = [(a, b) for a, b in zip(lemmas_of(tokens), tokens, strict=True) if a.lower() not in drop and b.lower() not in drop]
                out.append(tuple(" ".join(x.lower() if lower else x for x in side) for side in (zip(*pairs, strict=True) if pairs else ((), ()))))
            yield pd.DataFrame(out, columns=["lemmas", "tokens"])

    return run(col(c))


def subwords(c, model: str) -> Column:
    """Pieces of a sentence-piece model at a path that every executor has, joined by blanks; null
    texts are empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        for texts in batches:
            yield pd.Series([" ".join(pieces.encode(t or "", out_type=str)) for t in texts])

    return run(col(c))


# Content types, and the characters of a body that count.
HTML_TYPES, PLAIN_TYPE, MOST_CHARS = ("text/html", "application/xhtml+xml"), "text/plain", 32768
# End of fixed values.


def html_document(body, content_type, most: int = MOST_CHARS) -> Column:
    """A struct of body and title: bytes are read as UTF-8 with faults replaced and cut to ``most``
    characters; plain text passes, other types are empty."""
    x = F.substring(F.make_valid_utf8(col(body).cast("string")), 1, most)
    kind, none = col(content_type), F.lit("")
    html = kind.isin(*HTML_TYPES)
    page = F.when(html, parsed_page(F.when(html, x)))
    return F.struct(F.when(html, page["text"]).when(kind == PLAIN_TYPE, x).otherwise(none).alias("body"), F.when(html, page["title"]).otherwise(none).alias("title"))


def charset(headers) -> Column:
    """The charset that HTTP header lines name, or null."""
    found = F.regexp_extract(col(headers), r"(?:^|; |\r\n)charset=([^;\r\n=]+)", 1)
    return F.nullif(found, F.lit(""))


def qa_record(c) -> Column:
    """A struct of uri, subject, content, best (place of the best answer, or -1) and answers, from
    a <document> of a question archive; without uri or subject it is an error. Tags are removed."""

    def inner(tag: str) -> Column:
        return T.decode_entities(F.regexp_extract(col(c), f"(?s)<{tag}>(.*?)</{tag}>", 1))

    plain = lambda x: F.regexp_replace(x, "<[^>]*>", " ")
    raw = F.transform(F.regexp_extract_all(col(c), F.lit("(?s)<answer_item>(.*?)</answer_item>"), F.lit(1)), T.decode_entities)
    best = inner("bestanswer")
    whole = F.contains(col(c), F.lit("<uri>")) & F.contains(col(c), F.lit("<subject>"))
    uri = F.when(whole, inner("uri")).otherwise(F.raise_error(F.lit("a record without uri or subject")).cast("string"))
    at = F.when(best == "", F.lit(-1)).otherwise(F.array_position(raw, best).cast("int") - 1)
    return F.struct(uri.alias("uri"), F.trim(plain(inner("subject"))).alias("subject"), F.trim(plain(inner("content"))).alias("content"), at.alias("best"), F.transform(raw, plain).alias("answers"))


def valid_xml(c) -> Column:
    """Without characters that XML 1.0 forbids."""
    return F.regexp_replace(col(c), "[^\\u0009\\u000A\\u000D\\u0020-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]", "")


def without_xml_header(c) -> Column:
    return F.regexp_replace(col(c), r"^\s*<\?xml[^>]*\?>\s*", "")


def xml_entry(tag: str, **fields) -> Column:
    """An element with one child for each field; what XML reserves is escaped."""

    def safe(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    parts = [F.concat(F.lit(f"<{k}>"), safe(valid_xml(F.coalesce(col(v).cast("string"), F.lit("")))), F.lit(f"</{k}>")) for k, v in fields.items()]
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))
