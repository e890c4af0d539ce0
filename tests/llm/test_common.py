"""Shared pieces: folders, filters, hashes and samples."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.llm import common


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, name, default=None):
        return self.value if name == "spark.checkpoint.dir" and self.value else default


class _Session:
    def __init__(self, master, folder=None):
        self.conf = _Conf(folder)
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"test-{master}"})()


def test_shared_folder_is_the_clusters():
    assert common.shared_dir(_Session("spark://x", "hdfs://shared/")) == "hdfs://shared"
    assert common.shared_dir(_Session("local[2]")).startswith("/")
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(_Session(master))


def test_text_buffers():
    column = pa.array(["skip", "é", None, "", "abc", "tail"]).slice(1, 4)
    data, offsets = common.text_buffer(column)
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == ["é", "", "", "abc"]
    assert common.text_buffer(pa.array([], pa.string()))[1].tolist() == [0]
    assert list(common.slices(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_range_hashes_do_not_depend_on_the_place():
    x = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64) + np.uint64(5)
    x[300:340] = x[20:60]
    sums = common.prefix_sums(x)
    assert common.range_hash(sums, np.array([20]), np.array([60])) == common.range_hash(sums, np.array([300]), np.array([340]))
    assert (common.gram_hashes(sums, 7) == common.range_hash(sums, np.arange(494), np.arange(494) + 7)).all()


def test_equal_windows_have_equal_owners():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**60, 400).astype(np.uint64)
    x[200:300] = x[50:150]
    offsets = np.array([0, 180, 185, 400])
    grams = common.mix(common.gram_hashes(common.prefix_sums(x), 5))
    owner, lo, hi, row = common.minimisers(grams, offsets, 5, 20)
    owns = {}
    for o, a, b, r in zip(owner, lo, hi, row):
        for start in range(a, b + 1):
            assert start not in owns and offsets[r] <= start and start + 20 <= offsets[r + 1] and start <= o <= start + 15
            owns[start] = o - start
    assert sorted(owns) == [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 19)]
    assert all(owns[s] == owns[s + 150] for s in range(50, 131))


def test_whole_groups():
    h = np.sort(np.random.default_rng(3).integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(h[i : i + 37])], names=["h"]) for i in range(0, 500, 37)]
    pieces = [np.asarray(p.column(0)) for p in common.whole_groups(iter(batches), 50)]
    assert np.concatenate(pieces).tolist() == h.tolist()
    assert all(a[-1] != b[0] for a, b in zip(pieces, pieces[1:]))
    assert list(common.whole_groups(iter([]))) == []


def test_filters_lose_no_key(spark):
    keys = spark.range(0, 3000).select(F.xxhash64("id").alias("k"))
    some = keys.sample(0.3, seed=1).cache()
    table = common.key_bits(some, "k", 1 << 12)
    rows = keys.withColumn("row", F.lit("clash"))
    inside = common.split_by_bits(rows, table, "k", True, 1 << 12)
    outside = common.split_by_bits(rows, table, "k", False, 1 << 12)
    assert inside.columns == outside.columns == rows.columns
    assert inside.count() + outside.count() == 3000
    assert outside.join(some, "k").count() == 0
    values = np.array([r["k"] for r in keys.collect()], np.int64)
    hit = common.in_filter(common.key_filter(some, "k", 1 << 12), values.view(np.uint64))
    assert {int(v) for v in values[hit]} == {r["k"] for r in inside.collect()}
