"""Training of a linear text encoder: a vector for each of many places that words hash to,
summed over a text's words and scaled to length 1; queries and passages share it.

A step is synchronous and data-parallel: each shard of the batch gives the gradient of its
contrastive loss, in-batch passages and stored negatives being the wrong ones, gradients are
added up in a tree, and the driver, which holds nothing but the parameters, makes the step.
Shards and sums are in a fixed order, so a run that was stopped and goes on from its last
checkpoint ends with the same parameters as one that was not.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, audit
from ..session import durable
from ..sources import files

METHODS = ("dense", "mdr", "m3", "mopo")


@dataclass(frozen=True)
class Settings:
    """What a training run is made with; ``places`` and ``width`` bound the parameters."""

    method: str = "dense"
    epochs: int = 2
    batch: int = 64
    shards: int = 4
    places: int = 1 << 12
    width: int = 64
    rate: float = 0.05
    temperature: float = 0.05
    relevance_weight: float = 0.25
    teacher_weight: float = 0.1
    momentum: float = 0.999
    save_steps: int = 50
    seed: int = 42


@dataclass
class Parameters:
    step: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    teacher: np.ndarray
    losses: list[float]

    @staticmethod
    def start(s: Settings) -> Parameters:
        weights = np.random.default_rng(s.seed).normal(size=(s.places, s.width)) / s.width**0.5
        return Parameters(0, weights, np.zeros_like(weights), np.zeros_like(weights), weights.copy(), [])


def places_of(text: Column, places: int) -> Column:
    """The places of a text's words, in order."""
    return F.transform(T.word_list(text), lambda w: F.pmod(F.xxhash64(w), F.lit(places)).cast("int"))


def passage_text(passages: DataFrame) -> Column:
    return F.concat_ws(" ", *[T.text_or_empty(F.col(c)) for c in ("title", "text") if c in passages.columns])


def training_steps(positives: DataFrame, passages: DataFrame, s: Settings, negatives: DataFrame | None = None) -> DataFrame:
    """(step, shard, query_id, query, posterior, doc_id, doc, other_ids, others) over all epochs,
    texts as places: every epoch's rows rotate over the hops and are in an order of its own.
    ``positives(query_id, question, doc_ids)``; ``negatives(query_id, doc_id)``: a few for each."""
    docs = passages.select("doc_id", places_of(passage_text(passages), s.places).alias("doc"))
    facts = passages.select("doc_id", "text")
    wrong = None
    if negatives is not None:
        lists = negatives.join(docs, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "doc"))).alias("x"))
        wrong = lists.select("query_id", F.transform("x", lambda x: x["doc_id"].cast("string")).alias("other_ids"), F.transform("x", lambda x: x["doc"]).alias("others"))
    out, before = None, 0
    for epoch in range(s.epochs):
        rows = answers.epoch_order(answers.hop_training_rows(positives, facts, epoch, s.method), "query_id", s.seed, epoch)
        rows = rows.join(docs.withColumnRenamed("doc_id", "positive_id"), "positive_id")
        if wrong is not None:
            rows = rows.join(wrong, "query_id", "left")
        none = F.array().cast("array<string>"), F.array().cast("array<array<int>>")
        place = F.col("position") - 1
        rows = rows.select(
            F.lit(epoch).alias("epoch"), F.floor(place / s.batch).cast("int").alias("part"), (place % s.shards).cast("int").alias("shard"), F.col("query_id").cast("string").alias("query_id"),
            places_of(F.col("query"), s.places).alias("query"), places_of(F.col("posterior_query"), s.places).alias("posterior"), F.col("positive_id").cast("string").alias("doc_id"), "doc",
            *[(F.coalesce(c, n) if wrong is not None else n).alias(c) for c, n in zip(("other_ids", "others"), none)],
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _bags(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, the text of each, and how many words a text has (1 at least)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths())
    return np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(sizes)), sizes), np.maximum(sizes, 1)


def _vectors(bags: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and their lengths before."""
    places, owner, sizes = bags
    x = np.zeros((len(sizes), weights.shape[1]))
    np.add.at(x, owner, weights[places])
    x /= sizes[:, None]
    length = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    return x / length, length


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def shard_gradient(rows: pa.Table, weights: np.ndarray, teacher: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """The loss, summed over a shard's queries, and its gradient."""
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("query_id", "ascending")])).combine_chunks()
    ids = rows["doc_id"].to_pylist()
    names, lists = list(dict.fromkeys(ids)), {}
    for name, doc in zip(ids, rows["doc"].to_pylist()):
        lists.setdefault(name, doc)
    for others, docs in zip(rows["other_ids"].to_pylist(), rows["others"].to_pylist()):
        for name, doc in zip(others, docs):
            if name not in lists:
                names.append(name)
                lists[name] = doc
    asked, known = _bags(rows["query"]), _bags(pa.array([lists[n] for n in names], pa.list_(pa.int32())))
    q, q_length = _vectors(asked, weights)
    d, d_length = _vectors(known, weights)
    z = q @ d.T / s.temperature
    right = np.array(ids, object)[:, None] == np.array(names, object)[None, :]
    every, good = _softmax(z), _softmax(np.where(right, z, -1e9))
    top = z.max(axis=1)
    loss = float((np.log(np.exp(z - top[:, None]).sum(axis=1)) - np.log((np.exp(z - top[:, None]) * right).sum(axis=1) + 1e-300)).sum())
    pull = every - good
    if s.method == "m3":  # each passage is also judged by itself
        y = right.astype(float)
        loss += s.relevance_weight * float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).mean(axis=1).sum())
        pull = pull + s.relevance_weight * (1 / (1 + np.exp(-z)) - y) / len(names)
    if s.method == "mopo":  # the teacher has seen the evidence
        t = _softmax(_vectors(_bags(rows["posterior"]), teacher)[0] @ _vectors(known, teacher)[0].T / s.temperature)
        loss += s.teacher_weight * float((t * (np.log(t + 1e-300) - np.log(every + 1e-300))).sum())
        pull = pull + s.teacher_weight * (every - t)
    out = np.zeros_like(weights)
    for unit, length, bags, slope in ((q, q_length, asked, pull @ d / s.temperature), (d, d_length, known, pull.T @ q / s.temperature)):
        slope = (slope - (slope * unit).sum(axis=1, keepdims=True) * unit) / length
        places, owner, sizes = bags
        np.add.at(out, places, (slope / sizes[:, None])[owner])
    return loss, out


def _update(p: Parameters, gradient: np.ndarray, s: Settings) -> None:
    """One step of Adam on a gradient of length 1 at most; then the teacher moves a little."""
    gradient = gradient / max(1.0, float(np.sqrt((gradient * gradient).sum())))
    p.step += 1
    p.first = 0.9 * p.first + 0.1 * gradient
    p.second = 0.999 * p.second + 0.001 * gradient * gradient
    p.weights = p.weights - s.rate * (p.first / (1 - 0.9**p.step)) / (np.sqrt(p.second / (1 - 0.999**p.step)) + 1e-8)
    p.teacher = s.momentum * p.teacher + (1 - s.momentum) * p.weights


# ------------------------------------------------------------------- checkpoints

_STORED = "step int, run string, places int, width int, weights binary, first binary, second binary, teacher binary, losses array<double>"


def save(spark: SparkSession, p: Parameters, run: str, path: str) -> None:
    arrays = [bytearray(np.ascontiguousarray(x).tobytes()) for x in (p.weights, p.first, p.second, p.teacher)]
    spark.createDataFrame([(p.step, run, *p.weights.shape, *arrays, p.losses)], _STORED).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Parameters, str]:
    row = spark.read.schema(_STORED).parquet(path).first()
    arrays = [np.frombuffer(bytes(row[c]), np.float64).reshape(row["places"], row["width"]).copy() for c in ("weights", "first", "second", "teacher")]
    return Parameters(row["step"], *arrays, list(row["losses"])), row["run"]


def _gradient_of(shared, s: Settings):
    def gradient(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        loss, out = shard_gradient(table, *shared.value, s)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "loss": pa.array([loss]), "gradient": pa.array([out.tobytes()], pa.binary())})

    return gradient


def train(positives: DataFrame, passages: DataFrame, output: str, s: Settings = Settings(), negatives: DataFrame | None = None, most_steps: int | None = None) -> Parameters:
    """Trains, or goes on from the last checkpoint below ``output`` if it is of the same
    settings and data, and writes ``output/model``.  ``most_steps`` stops earlier."""
    if s.method not in METHODS:
        raise ValueError(f"unknown method {s.method!r}")
    spark = positives.sparkSession
    data = [audit.table_fingerprint(t.withColumn(c, F.to_json(c)) if c == "doc_ids" else t, [*t.columns]).first()["digest"] for t, c in ((positives, "doc_ids"), (passages.select("doc_id", passage_text(passages).alias("text")), ""))]
    run = hashlib.sha256(json.dumps([asdict(s), *data]).encode()).hexdigest()
    done = files.names(spark, f"{output}/checkpoints/step-*/_SUCCESS")
    p = Parameters.start(s)
    if done:
        p, held = load(spark, max(done).rsplit("/", 1)[0])
        if held != run:
            raise ValueError("the checkpoints are of other settings or data")
    keep = durable(spark)
    rows = keep(training_steps(positives, passages, s, negatives))
    sizes = rows.groupBy("epoch", "part").count().orderBy("epoch", "part").collect()  # a row for each step
    total = len(sizes) if most_steps is None else min(most_steps, len(sizes))

    def add(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("shard", "ascending")]))
        gradient = sum(np.frombuffer(b, np.float64) for b in table["gradient"].to_pylist())
        return pa.table({"shard": pa.array([min(table["shard"].to_pylist())], pa.int32()), "loss": pa.array([sum(table["loss"].to_pylist())]), "gradient": pa.array([gradient.tobytes()], pa.binary())})

    kind = "shard int, loss double, gradient binary"
    branch = max(1, round(s.shards**0.5))
    for step in sizes[p.step : total]:
        shared = spark.sparkContext.broadcast((p.weights, p.teacher))  # as large as the settings say

        mine = rows.where((F.col("epoch") == step["epoch"]) & (F.col("part") == step["part"]))
        parts = mine.groupBy("shard").applyInArrow(_gradient_of(shared, s), kind)
        parts = parts.groupBy((F.col("shard") % branch).alias("b")).applyInArrow(add, kind)
        found = sorted(parts.collect(), key=lambda r: r["shard"])  # a few sums of gradients
        p.losses.append(sum(r["loss"] for r in found) / step["count"])
        _update(p, sum(np.frombuffer(bytes(r["gradient"]), np.float64) for r in found).reshape(p.weights.shape) / step["count"], s)
        shared.unpersist()
        if p.step % s.save_steps == 0:
            save(spark, p, run, f"{output}/checkpoints/step-{p.step:08d}")
    if p.step == len(sizes):
        save(spark, p, run, f"{output}/model")
    return p


def encoder(weights: np.ndarray) -> Callable[[DataFrame, str], DataFrame]:
    """An encoder for ``stages.rank``: (id, text) and the id's name to (id, v).  A text without
    words has no vector."""

    def encode(rows: DataFrame, id_col: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(weights)
        read = rows.select(F.col(id_col).alias("id"), places_of(passage_text(rows), len(weights)).alias("bag")).where(F.size("bag") > 0)

        def run(batches):
            for batch in batches:
                v = _vectors(_bags(batch.column(1)), shared.value)[0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "v"])

        return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, v array<double>").withColumnRenamed("id", id_col)

    encode.__qualname__ = f"linear-{hashlib.sha256(weights.tobytes()).hexdigest()[:16]}"
    return encode


def load_encoder(spark: SparkSession, path: str) -> Callable[[DataFrame, str], DataFrame]:
    return encoder(load(spark, path)[0].weights)
