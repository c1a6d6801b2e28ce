"""Columns of any name pass through, whatever the operators call theirs."""

import random
from collections import Counter

import pytest

from ranklode.llm import decontam, mixing, ngram_join, quality, secrets
from ranklode.session import clean, made

NAMES = [
    "_row", "_id", "_bad", "_gone", "_rejected", "target", "source_size", "_src", "_copies", "_copy", "_rate", "size", "col", "g", "x0", "_pair", "pair", "by", "fits", "distance", "scale", "mean", "inv",
    "_g", "n_words", "n_lines", "label", "c", "b", "h", "n", "node", "comp", "doc", "d1", "item_id", "_share", "_w", "_k", "taken", "copies", "base_failed", "kept", "judged_by", "spans",
]


@pytest.fixture(scope="module")
def named(spark):
    r = random.Random(21)
    texts = ["\n".join(" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(10)) for _ in range(8)) for _ in range(12)]
    texts += [texts[0], None, "short", texts[1] + " password: abcdefgh123"]
    data = [(None if k % 7 == 3 else k, t, "en", "s" if k % 3 else None, *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)), data


OPERATORS = {
    "emit": (mixing.emit, 1.2), "keep": (quality.keep, 0.5), "one_of_each": (ngram_join.one_of_each, 0.5), "redact": (secrets.redact, 1.0),
    "drop": (lambda d: decontam.drop(d, d.sparkSession.createDataFrame([(1, "never said at all")], "item_id long, text string")), 1.0),
    "clean": (lambda d: decontam.clean(d, d.sparkSession.createDataFrame([(1, "never said at all")], "item_id long, text string")), 1.0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names(named, name):
    docs, data = named
    operator, share = OPERATORS[name]
    out = operator(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = [tuple(x) for x in out.collect()]
    known = {x[4:]: x for x in data}
    assert len(got) >= share * len(data) * 0.9 and all(x[4:] in known and x[0] == known[x[4:]][0] for x in got)
    if name in ("redact", "drop", "clean"):
        assert Counter(x[4:] for x in got) == Counter(known.keys())
    assert operator(docs.limit(0)).collect() == []


def test_statistics_and_scans_of_any_names(named):
    docs, data = named
    for out in (quality.judged(docs), ngram_join.classes(docs), secrets.scan(docs), mixing.shares(docs)):
        assert out.count() == len(data)


def test_nothing_is_left(spark, named):
    since = made()
    ngram_join.classes(named[0]).collect()
    assert made() > since
    clean(spark, since)
    assert made() == since
