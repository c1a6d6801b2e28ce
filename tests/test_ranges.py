"""Files by ranges cut at every byte, and vector files written by many tasks."""

import io
import json
import random
import struct

import numpy as np
import pytest

from ranklode.sources import ranges, vector_files


def entry(docno, **fields):
    body = b"".join((b"\x02" if isinstance(v, str) else b"\x05") + k.encode() + b"\0" + (struct.pack("<i", len(v.encode()) + 1) + v.encode() + b"\0" if isinstance(v, str) else struct.pack("<i", len(v)) + b"\0" + v) for k, v in {"DOCNO": docno, **fields}.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def entries(seed=1, n=12):
    r = random.Random(seed)
    return [entry(f"d{k}é", text="".join(r.choice("ab\x01é") for _ in range(r.randint(0, 30))), vec=bytes(r.choice((0, 2, 5, 9)) for _ in range(r.randint(0, 40)))) for k in range(n)]


def test_first_entries_from_every_byte():
    some = entries()
    whole = b"".join(some)
    starts = np.cumsum([0, *map(len, some)]).tolist()
    data = ranges.Bytes(io.BytesIO(whole), len(whole))
    for at in range(1, len(whole)):
        assert ranges.first_entry(data, at) == min(s for s in starts if s >= at), at
    assert ranges.entry(data, 0)[0]["DOCNO"] == "d0é" and ranges.entry(data, 1)[0] is None and ranges.entry(data, len(whole))[0] is None


def test_bson_by_ranges(spark, tmp_path):
    some = entries(2, 40)
    (tmp_path / "a.bson").write_bytes(b"".join(some))
    (tmp_path / "b.bson").write_bytes(b"")
    (tmp_path / "c.bson").write_bytes(entry("big", vec=bytes(5000)) + entry("last", t="x"))
    want = None
    for size in (1 << 20, 700, 64):
        df = ranges.bson(spark, str(tmp_path), size)
        got = sorted((r.DOCNO, r.field, bytes(r.value)) for r in df.collect())
        want = want or got
        assert got == want and len(got) == 82
        if size < 1 << 20:
            assert df.rdd.getNumPartitions() > 10
    plan = ranges.planned(str(tmp_path / "a.bson"), 700)
    assert [a for *_, a, _ in plan] == list(range(0, plan[0][1], 700)) and plan[-1][3] == plan[0][1]


def test_bson_that_cannot_be_told_apart(spark, tmp_path):
    """A field that holds a run of entries is an error, not wrong rows; in one range it is read."""
    inner = b"".join(entries(3, 9))
    (tmp_path / "x.bson").write_bytes(entry("outer", vec=inner + bytes(50)) + entry("next", t="y"))
    with pytest.raises(Exception, match="can't be told apart"):
        ranges.bson(spark, str(tmp_path / "x.bson"), 100).collect()
    assert ranges.bson(spark, str(tmp_path / "x.bson")).count() == 2
    (tmp_path / "y.bson").write_bytes(entry("a", t="y")[:-3])
    with pytest.raises(Exception, match="no entry"):
        ranges.bson(spark, str(tmp_path / "y.bson")).collect()


def test_a_file_beyond_two_gigabytes_is_planned(tmp_path):
    with (tmp_path / "large").open("wb") as f:
        f.truncate(3 << 30)  # a hole: takes no disk
    plan = ranges.planned(str(tmp_path / "large"))
    assert len(plan) == 96 and plan[-1][3] == 3 << 30 and all(b - a <= ranges.RANGE_BYTES for *_, a, b in plan)


OBJECTS = [{"q": 'a "quoted" \\ [{] text', "n": [1, {"x": "}"}]}, {}, {"q": "\\\\\\\"", "n": []}, {"é": "{\U0001f600", "deep": {"a": [{"b": [{}]}]}}, {"q": "long " * 30}]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_cut_at_every_byte(indent):
    text = (" \n" + json.dumps(OBJECTS, indent=indent, ensure_ascii=False)[:-1] + ', 7, "{no}", [{"not": "mine"}]]').encode()
    stream = io.BytesIO(text)
    for cut in range(1, len(text)):
        got, inside, depth = [], False, 0
        for a, b in ((0, cut), (cut, len(text))):
            odd = ranges._odd_before(stream, a)
            got += [json.loads(x) for x in ranges.objects(stream, len(text), a, b, inside, depth)]
            flips, out, within = ranges.changes(np.frombuffer(text[a:b], np.uint8), odd)
            depth, inside = depth + (within if inside else out), inside ^ flips
        assert got == OBJECTS and not inside and depth == 0, cut


def test_json_by_ranges(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    many = [{"q": "".join(r.choice('ab"\\{}[]é ') for _ in range(r.randint(0, 60))), "n": list(range(k % 5))} for k in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(many))
    (tmp_path / "b.json").write_text("[]")
    for size in (1 << 20, 97):
        got = ranges.json_objects(spark, str(tmp_path), "q string, n array<int>", size).collect()
        assert sorted((x.q, x.n) for x in got) == sorted((x["q"], x["n"]) for x in many)
    assert ranges.json_objects(spark, str(tmp_path / "b.json")).collect() == []
    (tmp_path / "c.json").write_text('{"q": "no array"}')
    with pytest.raises(Exception, match="no JSON array"):
        ranges.json_objects(spark, str(tmp_path / "c.json")).collect()


def test_vector_file(spark, tmp_path):
    r = random.Random(5)
    data = [(f"id{k:03d}", [r.random() for _ in range(4)], [(d, r.random()) for d in sorted(r.sample(range(99), k % 6), reverse=True)]) for k in range(200)]
    df = spark.createDataFrame(data, "id string, dense array<float>, sparse array<struct<dim:int, val:float>>").repartition(7)
    path = f"file://{tmp_path}/out.bin"
    assert vector_files.write(df, path, [("dense", False, 4), ("sparse", True, 99)], 5) == 200
    kinds, got = vector_files.read(path)
    assert kinds == [(False, 4), (True, 0)]
    f32 = lambda x: float(np.float32(x))
    assert got == [(i, [f32(x) for x in d], sorted((p, f32(v)) for p, v in s)) for i, d, s in sorted(data)]
    assert [p.name for p in tmp_path.iterdir()] == ["out.bin"]
    raw = (tmp_path / "out.bin").read_bytes()
    vector_files.write(df.repartition(2), path, [("dense", False, 4), ("sparse", True, 99)], 3)
    assert (tmp_path / "out.bin").read_bytes() == raw  # however it is dealt
    assert vector_files.write(df.limit(0), path, [("dense", False, 4)]) == 0 and vector_files.read(path) == ([(False, 4)], [])
    for bad, what in (("'é'", "ASCII"), ("null", "ASCII"), ("'a'", "dimensions")):
        with pytest.raises(Exception, match=what):
            vector_files.write(df.limit(1).selectExpr(f"{bad} id", "slice(dense, 1, 3) dense"), path, [("dense", False, 4)])
    assert vector_files.read(path) == ([(False, 4)], [])  # what was there stays
