import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c int, b string, h int, x double, _n int, size long, score double, n_words int"


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, odd and empty texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéxyz") for _ in range(r.randint(2, 7))) for _ in range(300)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, texts = say(55), []
    for k in range(n):
        w = say(r.randint(60, 160))
        if k % 5 == 0:
            w[10:10] = passage
        texts.append(" ".join(w))
    for k in range(0, 20, 2):
        w = texts[k].split()
        for _ in range(k // 2):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append("  ".join(w))
    texts += [texts[3], texts[3], texts[4].upper(), "", " \t\n\v\f\r ", None, "one", "one", "One", "a b c", "a b c d", "ab " * 70, "x y " * 60, "x y z " * 50]
    texts.append(" ".join(say(9000)))
    texts.append("é中\U0001f600 " * 40 + "café\x00 nul")
    ids = list(range(len(texts)))
    r.shuffle(ids)
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], f"s{i % 4}" if i % 7 else None, None, 1, "b", 2, 0.5, 3, 4, 0.1, 5) for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[0])  # a repeated row
    rows += [(None, texts[0], "en", "s1", None, *rows[0][5:]), (None, None, None, None, None, *[None] * 8)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
