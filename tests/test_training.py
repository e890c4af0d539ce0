"""Training of the linear encoder: gradients, resuming, and what it learns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.operators import dense, evaluation
from trailmark.plans import stages, training


def table(rng, n, places):
    bag = lambda: rng.integers(0, places, rng.integers(1, 6)).tolist()
    docs = [f"d{i % 4}" for i in range(n)]
    texts = {d: bag() for d in {*docs, "x1", "x2"}}
    return pa.table({
        "query_id": [f"q{i}" for i in range(n)], "query": pa.array([bag() for _ in range(n)], pa.list_(pa.int32())), "posterior": pa.array([bag() for _ in range(n)], pa.list_(pa.int32())),
        "doc_id": docs, "doc": pa.array([texts[d] for d in docs], pa.list_(pa.int32())), "other_ids": [["x1"], ["x1", "x2"]] + [[]] * (n - 2),
        "others": pa.array([[texts["x1"]], [texts["x1"], texts["x2"]]] + [[]] * (n - 2), pa.list_(pa.list_(pa.int32()))),
    })


@pytest.mark.parametrize("method", training.METHODS)
def test_gradients_match_differences(method):
    rng = np.random.default_rng(3)
    s = training.Settings(method=method, places=7, width=3, temperature=0.5)
    rows, w, t = table(rng, 6, 7), rng.normal(size=(7, 3)), rng.normal(size=(7, 3))
    _, gradient = training.shard_gradient(rows, w, t, s)
    for place in np.ndindex(7, 3):
        up, down = w.copy(), w.copy()
        up[place] += 1e-6
        down[place] -= 1e-6
        slope = (training.shard_gradient(rows, up, t, s)[0] - training.shard_gradient(rows, down, t, s)[0]) / 2e-6
        assert gradient[place] == pytest.approx(slope, abs=1e-5)


def corpus(spark, n=24):
    """Queries never share a word with their passages, but always the number."""
    docs = spark.createDataFrame([(f"d{i}", f"topic{i}", f"alpha{i} beta{i % 5} common") for i in range(n)], "doc_id string, title string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"frage{i} wort{i % 7}", [f"d{i}"]) for i in range(n)], "query_id string, question string, doc_ids array<string>")
    return docs, asked


def test_training_learns_and_resumes(spark, tmp_path):
    docs, asked = corpus(spark)
    s = training.Settings(epochs=5, batch=12, shards=2, places=256, width=16, rate=0.2, save_steps=4)
    whole = training.train(asked, docs, str(tmp_path / "a"), s)
    assert whole.step == 10 and whole.losses[-1] < 0.5 * whole.losses[0]
    training.train(asked, docs, str(tmp_path / "b"), s, most_steps=6)
    again = training.train(asked, docs, str(tmp_path / "b"), s)
    assert (again.weights == whole.weights).all() and (again.teacher == whole.teacher).all() and again.losses == whole.losses
    with pytest.raises(ValueError, match="other settings"):
        training.train(asked, docs, str(tmp_path / "b"), training.Settings(epochs=5, batch=12, shards=2, places=256, width=16, rate=0.1, save_steps=4))
    queries = asked.select("query_id", F.col("question").alias("text"))
    qrels = asked.select("query_id", F.explode("doc_ids").alias("doc_id"), F.lit(1).alias("gain"))
    recall = {}
    for name, encode in (("trained", training.load_encoder(spark, str(tmp_path / "a/model"))), ("hashed", dense.hashed_vectors)):
        ranked = stages.rank("dense", queries, docs, 5, encode=encode)
        recall[name] = evaluation.ranking_metrics(qrels, ranked, (5,)).first()["recall"]
    assert recall["trained"] > 0.8 > recall["hashed"]


def test_steps_hold_every_example_once_an_epoch(spark):
    docs, asked = corpus(spark, 10)
    two = asked.withColumn("doc_ids", F.array(F.get("doc_ids", F.lit(0)), F.lit("d0"), F.lit("gone")))
    negatives = spark.createDataFrame([("q1", "d5"), ("q1", "d2")], "query_id string, doc_id string")
    rows = training.training_steps(two, docs, training.Settings(method="mdr", epochs=2, batch=4, shards=3), negatives).collect()
    for epoch in (0, 1):
        mine = [r for r in rows if r["epoch"] == epoch]
        assert sorted(r["query_id"] for r in mine) == sorted(f"q{i}" for i in range(10)) and max(r["part"] for r in mine) == 2
        assert all(sum(r["part"] == p for r in mine) <= 4 for p in range(3))
    assert {r["doc_id"] for r in rows if r["epoch"] == 1 and r["query_id"] != "q0"} == {"d0"}  # hops rotate
    assert [r["other_ids"] for r in rows if r["query_id"] == "q1"] == [["d2", "d5"]] * 2
