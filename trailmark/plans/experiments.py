"""Experiments as graphs of steps: methods x seeds x splits, from raw files to tables.

A step's key is a hash of its name, its settings, the bytes of the files it reads and the
keys of the steps it needs.  The key is written next to the step's output when the step
has ended; a step whose key is there is skipped, so a run goes on where another
stopped, and a changed input or setting redoes only what depends on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..sources import files
from . import stages


@dataclass(frozen=True)
class Step:
    """``run(spark)`` writes ``output``, a folder; ``needs`` are names of earlier steps and
    ``inputs`` files or folders that no step writes."""

    name: str
    output: str
    run: Callable[[SparkSession], None]
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    settings: dict[str, object] = field(default_factory=dict)


def input_digest(spark: SparkSession, path: str) -> str:
    """A hash of the names and bytes of all files of a path."""
    found = audit.file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return audit.table_fingerprint(found, ["name", "sha256"]).first()["digest"]


def _mark(step: Step) -> str:
    return f"{step.output.rstrip('/')}/_step"


def _held(spark: SparkSession, step: Step) -> str | None:
    """The key of the step that wrote an output and ended."""
    done = files.names(spark, f"{_mark(step)}/_SUCCESS")
    return spark.read.text(_mark(step)).first()[0] if done else None


def run_steps(spark: SparkSession, steps: Sequence[Step]) -> dict[str, str]:
    """Runs steps in order, those that are needed first: name to "done" or "skipped"."""
    keys: dict[str, str] = {}
    digests: dict[str, str] = {}
    out: dict[str, str] = {}
    for step in steps:
        lacking = [n for n in step.needs if n not in keys]
        if lacking or step.name in keys:
            raise ValueError(f"step {step.name}: {'needs ' + lacking[0] if lacking else 'is there twice'}")
        for path in step.inputs:
            digests.setdefault(path, input_digest(spark, path))
        whole = [step.name, step.output, sorted((k, repr(v)) for k, v in step.settings.items()), [digests[p] for p in step.inputs], [keys[n] for n in step.needs]]
        keys[step.name] = hashlib.sha256(json.dumps(whole).encode()).hexdigest()
        if _held(spark, step) == keys[step.name]:
            out[step.name] = "skipped"
            continue
        step.run(spark)
        spark.createDataFrame([(keys[step.name],)], "value string").coalesce(1).write.mode("overwrite").text(_mark(step))
        out[step.name] = "done"
    return out


def retrieval_experiment(
    qa_dir: str, structured_dir: str, output: str, methods: Sequence[str] = ("bm25",), seeds: Sequence[int] = (42,), splits: Sequence[str] = ("dev",), track: str = "true_multihop", top_k: int = 100,
    depth: int = 100, hops: int = 3, fold: str = "none", qa_top_k: int = 10, reader_method: str = "pathfid", max_source: int = 2048, max_passage: int = 256,
) -> list[Step]:
    """Samples, corpus and tracks, then a retrieval run and a reader's run for every method,
    seed and split, and their tables.  Runs share one stored index and vector store."""
    ir, exp = f"{output}/ir", f"{output}/exp"
    of_split = lambda df, split: df.where(F.col("split") == split)

    def create(spark: SparkSession) -> None:
        stages.create_from_structured(spark, qa_dir, structured_dir, ir)

    def prepare(spark: SparkSession) -> None:
        stages.prepare(spark, ir, structured_dir, exp)

    def tables(spark: SparkSession, split: str):
        samples = of_split(files.read_jsonl(spark, f"{exp}/{track}/queries", stages.SAMPLES), split)
        return samples, files.read_jsonl(spark, f"{exp}/corpus", stages.PASSAGES)

    def retrieve(method: str, seed: int, split: str, path: str) -> Callable[[SparkSession], None]:
        def run(spark: SparkSession) -> None:
            samples, passages = tables(spark, split)
            qrels = of_split(files.read_qrels(spark, f"{exp}/{track}/qrels"), split)
            queries = samples.select("query_id", F.col("query").alias("text"))
            stages.retrieval_run(method, queries, passages, path, qrels, top_k, depth, hops, fold=fold, store=f"{output}/store", split=split, track=track, seed=seed)

        return run

    def read(method: str, seed: int, split: str, path: str) -> Callable[[SparkSession], None]:
        def run(spark: SparkSession) -> None:
            samples, passages = tables(spark, split)
            stages.reader_run(
                samples, files.read_jsonl(spark, f"{path}/rankings", files.RANKINGS), passages, stages.read_qa(spark, qa_dir), f"{path}-read", qa_top_k, reader_method, max_source, max_passage,
                retrieval_method=method, retrieval_seed=seed, split=split, track=track,
            )

        return run

    def compare(kind: str, paths: list[str], summarize, columns: list[str], name: str) -> Callable[[SparkSession], None]:
        def run(spark: SparkSession) -> None:
            rows = spark.read.json([f"{p}/metrics" for p in paths])
            files.write_comparison(summarize(rows, {"track": track}), [c for c in columns if c in rows.columns], f"{output}/{name}/table")

        return run

    setting = {"track": track, "top_k": top_k, "depth": depth, "hops": hops, "fold": fold}
    reading = {"k": qa_top_k, "method": reader_method, "source": max_source, "passage": max_passage}
    steps = [Step("create", ir, create, inputs=(qa_dir, structured_dir)), Step("prepare", exp, prepare, ("create",), (structured_dir,))]
    runs: list[tuple[str, str]] = []
    for seed in seeds:
        for method in methods:
            for split in splits:
                name = f"{track}_{method}_seed{seed}_{split}"
                path = f"{output}/runs/{name}"
                runs.append((name, path))
                steps.append(Step(f"retrieve {name}", path, retrieve(method, seed, split, path), ("prepare",), settings={**setting, "method": method, "seed": seed, "split": split}))
                steps.append(Step(f"read {name}", f"{path}-read", read(method, seed, split, path), (f"retrieve {name}",), (qa_dir,), reading))
    steps.append(Step("compare", f"{output}/comparison", compare("retrieve", [p for _, p in runs], stages.summarize_runs, stages.IR_TABLE, "comparison"), tuple(f"retrieve {n}" for n, _ in runs)))
    steps.append(Step("compare readers", f"{output}/qa-comparison", compare("read", [f"{p}-read" for _, p in runs], stages.summarize_readers, stages.QA_TABLE, "qa-comparison"), tuple(f"read {n}" for n, _ in runs)))
    return steps
