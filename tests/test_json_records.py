"""The record splitter against json.load."""

import json
import random

import pytest

from lexloom.sources import json_io
from lexloom.sources.json_records import json_members


def value(r, depth=0):
    kind = r.randint(0, 8 if depth < 3 else 5)
    if kind <= 3:
        return "".join(r.choice(['"', "\\", ",", "{", "}", "[", "]", ":", "é", "\n", "điều", "\U0001f600", "a ", "\\\\", '\\"']) for _ in range(r.randint(0, 14)))
    if kind <= 5:
        return r.choice([None, True, 1, -2.5, 10**15])
    return [value(r, depth + 1) for _ in range(r.randint(0, 4))] if kind == 6 else {value_key(r): value(r, depth + 1) for _ in range(r.randint(0, 4))}


def value_key(r):
    return "".join(r.choice(['"', ",", "}", "k", "é", " "]) for _ in range(r.randint(0, 5)))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(6))
def test_members_equal_json_load(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    data = [value(r) for _ in range(120)] if seed % 2 else {value_key(r) + str(i % 90): value(r) for i in range(120)}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(data, ensure_ascii=bool(seed & 2), indent=[None, 1, None, 3, None, 2][seed]), encoding="utf-8")
    kind, rows = json_members(spark, str(path))
    got = sorted(rows.collect())
    if isinstance(data, dict):
        assert kind == "OBJECT" and [(x.key, json.loads(x.value)) for x in got] == list(data.items())
    else:
        assert kind == "ARRAY" and [json.loads(x.value) for x in got] == data and [x.pos for x in got] == list(range(len(data)))


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    path = tmp_path / "f.json"
    path.write_text(json.dumps([{"id": i, "question": "q" * 50} for i in range(200)]))
    assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 10
    assert json_io.read_split(spark, str(path)).count() == 200


@pytest.mark.parametrize("text, want", [("[]", []), (" {} ", []), ("[ 1 ]", ["1"]), ('\ufeff[1,"a,b"]', ["1", '"a,b"']), ('{"a":1,"b":2,"a":[3,4]}', ["[3,4]", "2"])])
def test_small_files(spark, tmp_path, text, want):
    path = tmp_path / "f.json"
    path.write_text(text, encoding="utf-8")
    assert [r.value for r in json_members(spark, str(path))[1].orderBy("pos").collect()] == want


@pytest.mark.parametrize("text", ["", "1", '"a"', "[1", '{"a": "b}', "[1]]"])
def test_other_files_are_refused(spark, tmp_path, text):
    path = tmp_path / "f.json"
    path.write_text(text)
    with pytest.raises(ValueError):
        json_members(spark, str(path))


def test_limits_follow_the_file(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"z": {"question": "1"}, "a": {"question": "2"}, "m": {"question": "3", "id": "own"}}))
    assert [(r.id, r.question) for r in json_io.read_split(spark, str(path), limit=2).orderBy("pos").collect()] == [("z", "1"), ("a", "2")]
    assert {r.id for r in json_io.read_split(spark, str(path)).collect()} == {"z", "a", "own"}
