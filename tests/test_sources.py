import bz2
import gzip
import json
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ranklode.sources import files as S


def test_run_round_trip(spark, tmp_path):
    want = {("1", "0", 3, 1.0), ("1", "2", 1, 3.0), ("1", "1", 2, 2.0), ("2", "4", 1, 35.0), ("2", "3", 2, 3.0)}
    r = spark.createDataFrame(list(want), "query_id string, doc_id string, rank int, score double")
    S.write_run(r, str(tmp_path / "run"), "x")
    for strict in (False, True):
        assert {tuple(x[k] for k in ("query_id", "doc_id", "rank", "score")) for x in S.run(spark, str(tmp_path / "run"), strict).collect()} == want


def test_strict_run_needs_contiguous_ranks(spark, tmp_path):
    (tmp_path / "r").write_text("1 Q0 a 1 2.0 x\n1 Q0 b 3 1.0 x\n")
    with pytest.raises(PySparkException):
        S.run(spark, str(tmp_path / "r"), True).collect()


@pytest.mark.parametrize("pack", [lambda p, s: p.write_bytes(s), lambda p, s: p.with_suffix(".gz").write_bytes(gzip.compress(s)), lambda p, s: p.with_suffix(".bz2").write_bytes(bz2.compress(s))])
def test_qrels_in_any_compression(spark, tmp_path, pack):
    pack(tmp_path / "q", b"1 0 a 2\n\n1\t0  b 0.5\n2 0 a 1\n")
    assert {tuple(r) for r in S.qrels(spark, str(tmp_path / "q*")).collect()} == {("1", "a", 2.0), ("1", "b", 0.5), ("2", "a", 1.0)}


def test_bad_and_inconsistent_qrels(spark, tmp_path):
    (tmp_path / "q").write_text("1 0 a\n")
    with pytest.raises(PySparkException):
        S.qrels(spark, str(tmp_path / "q")).collect()
    q = spark.createDataFrame([("1", "a", 1.0), ("1", "a", 1.0), ("1", "b", 1.0)], "query_id string, doc_id string, grade double")
    assert S.unique_qrels(q).count() == 2
    with pytest.raises(PySparkException):
        S.unique_qrels(q.unionByName(q.withColumn("grade", F.col("grade") + 1))).collect()


def test_features_and_weights(spark, tmp_path):
    d = spark.createDataFrame([("7", 2.0, [0.5, 1.5]), ("7", 0.0, [0.0, -1.0])], "query_id string, grade double, feats array<double>")
    S.write_features(d, str(tmp_path / "f"))
    assert {(r.query_id, r.grade, tuple(r.feats)) for r in S.features(spark, str(tmp_path / "f")).collect()} == {("7", 2.0, (0.5, 1.5)), ("7", 0.0, (0.0, -1.0))}
    (tmp_path / "g").write_text("1 qid:3 1:2 3:4 # a note\n")
    assert S.features(spark, str(tmp_path / "g")).first().feats == [2.0, None, 4.0]
    S.write_weights(spark, [1.0, 2.5], str(tmp_path / "w"))
    assert S.weights(spark, str(tmp_path / "w")) == [1.0, 2.5]
    (tmp_path / "bad").write_text("# model\n1:1 3:2\n")
    with pytest.raises(ValueError):
        S.weights(spark, str(tmp_path / "bad"))


def test_entries(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"DOCNO": "1", "text": "a b", "n": 5, "answer_list": ["x", "y"]}\n\n{"DOCNO": "2", "text": "c"}\n')
    schema = "DOCNO string, text string, n string, answer_list array<string>"
    e = S.entries(spark, str(tmp_path / "e.jsonl"), schema)
    assert {(r.DOCNO, r.text, r.n, tuple(r.answer_list or ())) for r in e.collect()} == {("1", "a b", "5", ("x", "y")), ("2", "c", None, ())}
    S.write_entries(e, str(tmp_path / "out"))
    assert S.entries(spark, str(tmp_path / "out"), schema).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"text": "no id"}\n')
    with pytest.raises(PySparkException):
        S.entries(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    b = spark.createDataFrame([("1", b"x"), ("2", b"y")], "DOCNO string, v binary")
    assert S.parallel_queries(e, b).count() == 2
    with pytest.raises(PySparkException):
        S.parallel_queries(e, b.limit(1)).collect()


def _bson(**fields):
    body = b""
    for k, v in fields.items():
        if isinstance(v, str):
            body += b"\x02" + k.encode() + b"\0" + struct.pack("<i", len(v.encode()) + 1) + v.encode() + b"\0"
        else:
            body += b"\x05" + k.encode() + b"\0" + struct.pack("<i", len(v)) + b"\0" + v
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def test_binary_entries_and_vectors(spark, tmp_path):
    dense = struct.pack("<i2f", 0, 1.5, -2.0)
    sparse = struct.pack("<iiifif", 1, 2, 3, 0.5, 9, 1.0)
    (tmp_path / "v.bin").write_bytes(_bson(DOCNO="a", d=dense, s=sparse) + _bson(DOCNO="b", d=dense))
    x = S.bson_entries(spark, str(tmp_path / "v.bin"))
    assert x.count() == 3
    d = x.filter("field = 'd'").select("DOCNO", S.dense_from_packed("value").alias("v"))
    assert [tuple(r.v) for r in d.collect()] == [(1.5, -2.0)] * 2
    assert [(p.id, p.val) for p in x.filter("field = 's'").select(S.sparse_from_packed("value").alias("v")).first().v] == [(3, 0.5), (9, 1.0)]
    assert {bytes(r.b) for r in d.select(S.pack_dense("v").alias("b")).collect()} == {dense}


def test_words_training_and_translation(spark, tmp_path):
    (tmp_path / "s").write_text("The\n\n  of \n#note\n")
    assert {r.word for r in S.stop_words(spark, str(tmp_path / "s")).collect()} == {"the", "of", "#note"}
    assert {r.word for r in S.dictionary(spark, str(tmp_path / "s")).collect()} == {"The", "of"}
    (tmp_path / "e").write_text("a 3 4\nb 0 0\na 1 1\n")
    assert {r.word: tuple(r.v) for r in S.embeddings(spark, str(tmp_path / "e")).collect()}["a"] == (0.6, 0.8)
    (tmp_path / "bad").write_text("a 1 2\nb 1\n")
    with pytest.raises(ValueError):
        S.embeddings(spark, str(tmp_path / "bad"))
    (tmp_path / "t").write_text("query\t1\tq one\ndoc\t5\td five\nbroken line\n")
    q, d = S.training_texts(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in q.collect()] == [("1", "q one")] and [tuple(r) for r in d.collect()] == [("5", "d five")]
    S.write_training_texts(q, d, str(tmp_path / "t2"))
    assert S.training_texts(spark, str(tmp_path / "t2"))[0].collect() == q.collect()
    (tmp_path / "p").write_text("1\t5\n1\t6\t0.5\n")
    assert {tuple(r) for r in S.training_pairs(spark, str(tmp_path / "p")).collect()} == {("1", "5", 0.0), ("1", "6", 0.5)}
    (tmp_path / "voc").write_text("1 find 6\n2 lost 2\n")
    v = S.translation_vocabulary(spark, str(tmp_path / "voc"), spark.createDataFrame([("find",)], "word string"))
    assert [tuple(r) for r in v.collect()] == [(1, "find", 0.75)]
    (tmp_path / "tran").write_text("0 1 0.1\n1 1 0.9\n1 2 0.1\n")
    assert {tuple(r) for r in S.translation_table(spark, str(tmp_path / "tran"), v, v).collect()} == {("<null>", "find", 0.1), ("find", "find", 0.9)}


def test_collections(spark, tmp_path):
    (tmp_path / "c").write_text(".I 1\n.T\nfirst\ntitle\n.A\nauthor\n.B\nsrc\n.W\nbody text .\nmore\n.I 2\n.T\nsecond\n.A\n.B\n.W\nlast\n")
    got = {r.id: r for r in S.cranfield(spark, str(tmp_path / "c")).collect()}
    assert got[1].title == "first title" and got[1].body == "body text . more" and got[2].title == "second" and got[2].body == "last"
    (tmp_path / "j").write_text(json.dumps([{"question": "q", "answers": ["a"]}, {"question": "r", "answers": []}]))
    assert S.json_array(spark, str(tmp_path / "j"), "question string, answers array<string>").count() == 2
    (tmp_path / "x.xml").write_text("<docs><doc><id>1</id><text><![CDATA[a < b]]></text></doc><doc><id>2</id><text>c</text></doc></docs>")
    assert {r.text for r in S.xml_records(spark, str(tmp_path / "x.xml"), "doc", "id int, text string").collect()} == {"a < b", "c"}
