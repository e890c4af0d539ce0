"""Command line: ``python -m trailmark COMMAND ...``; run with --help for each."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import answers as qa_examples
from .operators import audit, corpus, dense
from .plans import experiments, pipelines, stages, training
from .session import local_session, ship
from .sources import files

QA_RUN = (
    "retrieval_method string, retrieval_seed int, reader_checkpoint string, reader_method string, reader_model_name string, split string, track string, top_k_contexts int, max_passage_tokens int, "
    "num_examples long, mean_retrieved_contexts double, rankings_fingerprint string, queries_fingerprint string, rouge_l double, meteor double, bertscore_f1 double"
)


def _at_least(a: argparse.Namespace, **least: int) -> None:
    """Refuses options below what makes sense."""
    for name, low in least.items():
        if getattr(a, name) < low:
            raise SystemExit(f"--{name.replace('_', '-')} must be at least {low}")


def filter_multihop(spark: SparkSession, a: argparse.Namespace) -> None:
    """Samples with enough contexts."""
    _at_least(a, min_contexts=1)
    rows = files.read_object_file(spark, a.input).select("key", "value.question", "value.answer", F.map_values("value.contexts").alias("contexts"))
    files.write_jsonl(corpus.min_contexts(rows, a.min_contexts), a.output)


def create_from_structured(spark: SparkSession, a: argparse.Namespace) -> None:
    """Samples, passages and judgements from QA files and structured documents."""
    stages.create_from_structured(spark, a.input_dir, a.structured_dir, a.output)


def create_samples(spark: SparkSession, a: argparse.Namespace) -> None:
    """Samples, passages and judgements from QA files and context files."""
    stages.create_samples(spark, a.input_dir, a.contexts_dir, a.output)


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """One corpus and the tracks' queries and judgements."""
    stages.prepare(spark, a.ir_dir, a.structured_dir, a.output)


def prepare_abstractive(spark: SparkSession, a: argparse.Namespace) -> None:
    """Examples for readers that write answers."""
    _at_least(a, distractors=0)
    stages.prepare_abstractive(spark, a.qa_dir, a.ir_dir, a.output, a.distractors, a.seed)


def prepare_extractive(spark: SparkSession, a: argparse.Namespace) -> None:
    """Passages and span labels for readers that mark answers."""
    _at_least(a, max_passages=2, passage_tokens=1, distractors=0)
    stages.prepare_extractive(spark, a.qa_dir, a.ir_dir, a.structured_dir, a.output, a.max_passages, a.passage_tokens, a.distractors, a.seed)


def _of_split(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The rows of ``--split``; the test split is read only if it is asked for twice."""
    if a.split == "test" and not a.final:
        raise SystemExit("the test split needs --final")
    return rows.where(F.col("split") == a.split) if a.split and "split" in rows.columns else rows


def _depths(a: argparse.Namespace) -> None:
    _at_least(a, top_k=1, max_hops=1)
    if a.top_k > a.search_depth:
        raise SystemExit("--search-depth must be at least --top-k")


def train_dense(spark: SparkSession, a: argparse.Namespace) -> None:
    """Train the linear encoder on samples and their passages, or go on with it."""
    _at_least(a, epochs=1, batch_size=1, save_steps=1)
    samples = _of_split(files.read_jsonl(spark, a.queries, stages.SAMPLES), a)
    positives = samples.select("query_id", F.col("query").alias("question"), F.array_distinct("positive_doc_ids").alias("doc_ids"))
    settings = training.Settings(method=a.method, epochs=a.epochs, batch=a.batch_size, save_steps=a.save_steps, seed=a.seed)
    made = training.train(positives, files.read_jsonl(spark, a.corpus, stages.PASSAGES), a.output, settings)
    print(f"{made.step} steps" + (f", loss {made.losses[0]:.4f} to {made.losses[-1]:.4f}" if made.losses else ""))


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rank passages for queries; with judgements, score the rankings."""
    _depths(a)
    encode = training.load_encoder(spark, a.model) if a.model else dense.hashed_vectors
    passages = files.read_jsonl(spark, a.corpus, stages.PASSAGES)
    queries = _of_split(files.read_jsonl(spark, a.queries, stages.SAMPLES), a).select("query_id", F.col("query").alias("text"))
    qrels = _of_split(files.read_qrels(spark, a.qrels), a).select("query_id", "doc_id", "gain") if a.qrels else None
    stages.retrieval_run(a.method, queries, passages, a.output, qrels, a.top_k, a.search_depth, a.max_hops, encode, a.fold, a.store, split=a.split, track=a.track, seed=a.seed)


def evaluate_qa(spark: SparkSession, a: argparse.Namespace) -> None:
    """Read the ranked passages and score the answers."""
    _at_least(a, top_k=1, max_source_length=256, max_passage_tokens=1)
    samples = _of_split(files.read_jsonl(spark, a.queries, stages.SAMPLES), a)
    rankings, passages = files.read_jsonl(spark, a.rankings, files.RANKINGS), files.read_jsonl(spark, a.corpus, stages.PASSAGES)
    stages.reader_run(
        samples, rankings, passages, stages.read_qa(spark, a.qa_dir), a.output, a.top_k, a.reader_method, a.max_source_length, a.max_passage_tokens, retrieval_method=a.retrieval_method, retrieval_seed=a.seed,
        split=a.split, track=a.track,
    )


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """A whole experiment: every method, seed and split; what is there already is kept."""
    _depths(a)
    _at_least(a, qa_top_k=1, max_source_length=256, max_passage_tokens=1)
    if "test" in a.splits and not a.final:
        raise SystemExit("the test split needs --final")
    steps = experiments.retrieval_experiment(
        a.qa_dir, a.structured_dir, a.output, a.methods, a.seeds, a.splits, a.track, a.top_k, a.search_depth, a.max_hops, a.fold, a.qa_top_k, a.reader_method, a.max_source_length, a.max_passage_tokens
    )
    for name, what in experiments.run_steps(spark, steps).items():
        print(f"{what}: {name}")


def evaluate_extractive(spark: SparkSession, a: argparse.Namespace) -> None:
    """Decode spans from a model's logits and score them."""
    logits = files.read_jsonl(spark, a.logits, "id string, passage long, position long, start_logit double, end_logit double")
    examples = _of_split(files.read_jsonl(spark, a.examples, "query_id string, flat_tokens array<string>, answer string"), a)
    predictions, means = stages.evaluate_spans(logits, examples)
    files.write_jsonl(predictions, f"{a.output}/predictions")
    files.write_manifest(means, f"{a.output}/metrics")


def summarize_qa(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reader metrics of several runs side by side."""
    runs = files.read_jsonl(spark, a.runs, QA_RUN)
    files.write_comparison(stages.summarize_readers(runs, {"track": a.track, "top_k_contexts": a.top_k}), stages.QA_TABLE, a.output)


def summarize_runs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics of several retrieval runs side by side, after checking what they read."""
    runs = spark.read.json(a.runs)
    files.write_comparison(stages.summarize_runs(runs, {"track": a.track, "search_depth": a.search_depth}), [c for c in stages.IR_TABLE if c in runs.columns], a.output)


def summarize_extractive(spark: SparkSession, a: argparse.Namespace) -> None:
    """Means and deviations of span models over seeds, after checking their runs."""
    root = a.runs.rstrip("/")
    run = lambda df: df.withColumn("run", F.element_at(F.split("path", "/"), -2))
    tree = lambda pattern: run(files.read_tree(spark, root, pattern))
    settings = tree("run_args.json").select("run", F.from_json("value", "map<string,string>").alias("m"))
    args = settings.select("run", F.col("m")["method"].alias("method"), F.col("m")["seed"].alias("seed"), F.explode("m").alias("name", "value"))
    complete = spark.createDataFrame([(p.split("/")[-2],) for p in files.names(spark, f"{root}/*/COMPLETE")], "run string")
    held = tree("*_metrics.json").select("run", F.regexp_extract("path", r"([^/]+)_metrics\.json$", 1).alias("split"), F.from_json("value", "method string, num_examples long, data string, metrics map<string,double>").alias("m"))
    metrics = held.join(settings.select("run", F.col("m")["seed"].alias("seed")), "run").select("run", "split", "m.method", "seed", "m.num_examples", "m.data", F.explode("m.metrics").alias("metric", "value"))
    files.write_comparison(stages.summarize_extractive(args, complete, metrics).orderBy("split", "method", "metric"), ["split", "method", "metric", "n", "mean", "std"], a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Score saved rankings."""
    files.write_comparison(pipelines.rescore(spark, a.rankings, a.qrels), ["k", "num_queries", "recall", "mrr", "ndcg", "map", "complete_evidence"], a.output)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Check queries, judgements and corpus against each other."""
    queries, qrels = files.read_jsonl(spark, a.queries, stages.SAMPLES), files.read_qrels(spark, a.qrels)
    audit.require(audit.validate(queries, qrels, files.read_jsonl(spark, a.corpus, stages.PASSAGES)))


def tracks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Judgements of one track."""
    files.write_qrels(corpus.filter_track(files.read_qrels(spark, a.qrels), a.track), a.output)


def answers(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mean answer metrics of saved predictions."""
    rows = files.read_jsonl(spark, a.predictions, "query_id string, prediction string, reference string")
    files.write_manifest(pipelines.answer_metrics(rows), a.output)


def summarize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Means and deviations over seeds of long-form run metrics."""
    runs = files.read_jsonl(spark, a.runs, "method string, seed int, metric string, value double")
    files.write_comparison(audit.summarize_seeds(runs).orderBy("method", "metric"), ["method", "metric", "n", "mean", "std"], a.output)


COMMANDS = {
    "filter-multihop": (filter_multihop, ["input", "output"]),
    "create-from-structured": (create_from_structured, ["input-dir", "structured-dir", "output"]),
    "create-samples": (create_samples, ["input-dir", "contexts-dir", "output"]),
    "prepare": (prepare, ["ir-dir", "structured-dir", "output"]),
    "prepare-abstractive": (prepare_abstractive, ["qa-dir", "ir-dir", "output"]),
    "prepare-extractive": (prepare_extractive, ["qa-dir", "ir-dir", "structured-dir", "output"]),
    "train-dense": (train_dense, ["corpus", "queries", "output"]),
    "retrieve": (retrieve, ["corpus", "queries", "output"]),
    "evaluate": (evaluate, ["rankings", "qrels", "output"]),
    "evaluate-qa": (evaluate_qa, ["rankings", "queries", "corpus", "qa-dir", "output"]),
    "evaluate-extractive": (evaluate_extractive, ["logits", "examples", "output"]),
    "evaluate-answers": (answers, ["predictions", "output"]),
    "validate": (validate, ["corpus", "queries", "qrels"]),
    "tracks": (tracks, ["qrels", "output"]),
    "summarize": (summarize, ["runs", "output"]),
    "summarize-runs": (summarize_runs, ["runs", "output"]),
    "summarize-qa": (summarize_qa, ["runs", "output"]),
    "run": (run, ["qa-dir", "structured-dir", "output"]),
    "summarize-extractive": (summarize_extractive, ["runs", "output"]),
}
#: Options of several commands: (flag, default, commands).
NUMBERS = (
    ("--distractors", 0, ["prepare-abstractive", "prepare-extractive"]), ("--seed", 42, ["prepare-abstractive", "prepare-extractive", "evaluate-qa", "retrieve", "train-dense"]), ("--epochs", 2, ["train-dense"]), ("--batch-size", 64, ["train-dense"]), ("--save-steps", 50, ["train-dense"]),
    ("--max-passages", 6, ["prepare-extractive"]), ("--passage-tokens", 256, ["prepare-extractive"]),
    ("--top-k", 100, ["retrieve", "run"]), ("--search-depth", 100, ["retrieve", "run", "summarize-runs"]), ("--max-hops", 3, ["retrieve", "run"]), ("--top-k", 10, ["evaluate-qa", "summarize-qa"]),
    ("--qa-top-k", 10, ["run"]), ("--max-source-length", 2048, ["evaluate-qa", "run"]), ("--max-passage-tokens", 256, ["evaluate-qa", "run"]), ("--min-contexts", 2, ["filter-multihop"]),
)


def parser() -> argparse.ArgumentParser:
    main_ = argparse.ArgumentParser(prog="trailmark", description=__doc__)
    subs = main_.add_subparsers(dest="command", required=True)
    for name, (run, paths) in COMMANDS.items():
        sub = subs.add_parser(name, help=run.__doc__)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        sub.set_defaults(run=run)
    for flag, default, commands in NUMBERS:
        for name in commands:
            subs.choices[name].add_argument(flag, type=int, default=default)
    for name in ("tracks", "evaluate-qa", "summarize-qa", "summarize-runs", "retrieve", "run"):
        subs.choices[name].add_argument("--track", choices=stages.TRACKS, default="true_multihop")
    for name in ("retrieve", "evaluate-qa", "evaluate-extractive", "train-dense"):
        subs.choices[name].add_argument("--split", choices=["train", "dev", "test"])
        subs.choices[name].add_argument("--final", action="store_true", help="allow the test split")
    subs.choices["retrieve"].add_argument("--method", choices=stages.METHODS, default="bm25")
    subs.choices["retrieve"].add_argument("--model", help="a trained encoder instead of the hashed stand-in")
    subs.choices["train-dense"].add_argument("--method", choices=training.METHODS, default="dense")
    subs.choices["retrieve"].add_argument("--qrels", help="score the rankings against these judgements")
    subs.choices["retrieve"].add_argument("--store", help="keep index and vectors here for later runs")
    for name in ("retrieve", "run"):
        subs.choices[name].add_argument("--fold", choices=text.FOLDS, default="none")
    for name in ("evaluate-qa", "run"):
        subs.choices[name].add_argument("--reader-method", choices=sorted(qa_examples.INSTRUCTIONS), default="pathfid")
    subs.choices["run"].add_argument("--methods", nargs="+", choices=stages.METHODS, default=["bm25"])
    subs.choices["run"].add_argument("--seeds", nargs="+", type=int, default=[42])
    subs.choices["run"].add_argument("--splits", nargs="+", choices=["train", "dev", "test"], default=["dev"])
    subs.choices["run"].add_argument("--final", action="store_true", help="allow the test split")
    subs.choices["evaluate-qa"].add_argument("--retrieval-method", default="bm25")
    return main_


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = spark or SparkSession.getActiveSession() or local_session()
    ship(session)
    args.run(session, args)


if __name__ == "__main__":
    main()
