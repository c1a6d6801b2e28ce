"""Ties of languages, and prototypes that are summed up in two steps."""

import numpy as np

from ranklode.llm import langid


def test_ties_go_to_the_first_language(spark):
    """Two languages with the same texts, however these are dealt to tasks."""
    one, two = "der hund und die katze gehen nach hause und schlafen ", "the dog and the cat are going home to sleep now "
    data = [(k, one * (1 + k % 3), ("zz", "bb", "cc")[k % 3]) for k in range(90)] + [(k, two * (1 + k % 3), "aa") for k in range(90, 180)]
    data += [(1000 + k, one * (1 + j), lang) for k, (j, lang) in enumerate((j, x) for j in range(3) for x in ("zz", "bb", "cc"))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for parts in (1, 7):
        dealt = docs.repartition(parts, "doc_id")
        table = langid.train(dealt.select("text", "lang").filter("lang <> 'aa'").unionByName(dealt.select("text", "lang").filter("lang = 'aa'")))
        table = {k: table["bb"] * (1 + 1e-9 * i) if k in ("bb", "cc", "zz") else v for i, (k, v) in enumerate(sorted(table.items()))}
        got = langid.predict(docs, table, "doc_id").collect()
        assert {r.lang_pred for r in got if r.doc_id < 90 or r.doc_id >= 1000} == {"bb"} and {r.lang_pred for r in got if 90 <= r.doc_id < 180} == {"aa"}


def test_sums_of_two_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words {k} here", "en" if k % 2 else "de") for k in range(60)], "doc_id long, text string, lang string").repartition(9)
    want = langid.train(docs)
    monkeypatch.setattr(langid, "PARTS", 2)
    got = langid.train(docs)
    assert list(got) == list(want) == ["de", "en"] and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
