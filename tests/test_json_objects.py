"""JSON files that are one object, cut into blocks of a few bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trailmark.sources import files
from trailmark.sources.json_objects import read_entries


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def odd_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", ",", "{", "}", "[", "]", ":", "ệ", "x", " ", "\n", "\\\""]) for _ in range(rng.randrange(40)))
    if kind == 3:
        return rng.choice([None, True, 1.5, -7, {}, []])
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {odd_value(rng, 3): odd_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_entries_are_those_of_the_whole_file(spark, tmp_path, small_blocks):
    expected = set()
    for i in range(6):
        rng = random.Random(i)
        data = {f"{n}{odd_value(rng, 3)}": odd_value(rng) for n in range(25)}
        text = json.dumps(data, indent=[None, 2, 1][i % 3], ensure_ascii=i % 2 == 0, separators=(",", ":") if i == 0 else None)
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8-sig" if i == 5 else "utf-8")
        expected |= {(f"{i}.json", k, json.dumps(v)) for k, v in data.items()}
    entries = read_entries(spark, str(tmp_path))
    assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 20
    rows = entries.collect()
    found = {(r["file"].rsplit("/", 1)[1], k, json.dumps(v)) for r in rows for k, v in json.loads("{" + r["text"] + "}").items()}
    assert found == expected and len(rows) == len(expected)


def test_values_have_the_given_schema(spark, tmp_path, small_blocks):
    data = {f"s{i}": {"question": 'wh, "y"?' * (i % 5), "n": i, "long": [i] * (i * 7 % 90)} for i in range(40)}
    (tmp_path / "qa.json").write_text(json.dumps(data))
    rows = files.read_object_file(spark, str(tmp_path / "qa.json"), "map<string,struct<question:string,n:long,long:array<int>>>").collect()
    assert {r["key"]: (r["value"]["question"], r["value"]["n"], r["value"]["long"]) for r in rows} == {k: (v["question"], v["n"], v["long"]) for k, v in data.items()}


def test_empty_objects_and_repeated_keys(spark, tmp_path):
    for name, text in (("a", "{}"), ("b", " \n{ \n} "), ("c", '{"k": 1, "k": 2}')):
        (tmp_path / f"{name}.json").write_text(text)
    rows = files.read_object_file(spark, str(tmp_path), "map<string,int>").select("key", "value").collect()
    assert sorted(map(tuple, rows)) == [("k", 1), ("k", 2)]


@pytest.mark.parametrize("text", ['{"a": 1', '{"a": 1}}', '[1, 2]', '{"a": 1} {"b": 2}', '{"a": 1,}', '{"a": 1,, "b": 2}', '{"a": "x}', '{"a": 1 2}', '{"a" 1}', '{"a": [1}]', 'x{"a": 1}', '{"a": 1}, 5', '{"a": "no number"}'])
def test_what_is_no_object_fails(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    match = None if "number" in text else "bad.json"
    with pytest.raises(Exception, match=match):
        files.read_object_file(spark, str(tmp_path / "bad.json"), "map<string,int>").collect()


def test_a_bad_entry_is_named_among_many_blocks(spark, tmp_path, small_blocks):
    good = json.dumps({f"k{i}": i for i in range(200)})
    (tmp_path / "bad.json").write_text(good.replace('"k150": 150', '"k150": 15 0'))
    with pytest.raises(Exception, match=r"bad.json, block at byte \d{4}: not JSON"):
        files.read_object_file(spark, str(tmp_path / "bad.json"), "map<string,int>").select(F.count("*")).collect()
