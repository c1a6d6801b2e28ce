import random
from collections import Counter

import corpus_pipeline as P
from ranklode.llm import decontam, mixing, ngram_join, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_do_what_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    kept = {r.doc_id for r in quality.judged(docs).filter("kept").collect()}
    step = P.STAGES[0][1](spark, docs, SF)
    assert {r.doc_id for r in step.collect()} == kept and step.columns == columns
    firsts = {r.doc_id for r in ngram_join.classes(step).collect() if r.doc_id == r.component_id}
    step = P.STAGES[1][1](spark, step, SF)
    assert {r.doc_id for r in step.collect()} == firsts and step.columns == columns
    bad = {r.doc_id for r in decontam.judged(step, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    step = P.STAGES[2][1](spark, step, SF)
    assert {r.doc_id for r in step.collect()} == firsts - bad
    step = P.STAGES[3][1](spark, step, SF)
    assert {r.doc_id: r.text for r in step.collect()} == {k: secrets.redacted(texts[k], "[SECRET]", frozenset()) for k in firsts - bad}
    copies = {r.doc_id: r.copies for r in mixing.shares(step).collect()}
    last = P.STAGES[4][1](spark, step, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert Counter(r.doc_id for r in P.run(spark, SF).collect()) == Counter({k: v for k, v in copies.items() if v})


def test_rows_are_judged_by_themselves(spark):
    r = random.Random(8)
    say = lambda k: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(k))
    good, passage = [say(80) for _ in range(6)], say(12)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int"
    row = lambda i, t: (i, t, "en", "s", None, 1)
    short = spark.createDataFrame([row(None, good[0]), row(None, "too short"), row(7, good[1]), row(7, None), row(8, good[2])], schema)
    out = quality.keep(short)
    assert out.columns == short.columns
    assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter([(None, good[0]), (7, good[1]), (8, good[2])])
    leaked = spark.createDataFrame([row(None, good[3]), row(None, f"{good[4]} {passage}"), row(7, good[4]), row(7, passage), row(9, None)], schema)
    out = decontam.clean(leaked, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.columns == leaked.columns
    assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter([(None, good[3]), (7, good[4]), (9, None)])
