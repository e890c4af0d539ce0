"""Compositions: prepared examples, saved-run scoring, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import answers, audit, evaluation
from ..session import durable
from ..sources import files


def abstractive_examples(samples: DataFrame, qa: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """``samples(query_id, source_qa_id, positive_doc_ids)`` with the answers of
    ``qa(source_qa_id, question, answer)``: ordered hops, and the positives followed by
    ``negatives(query_id, doc_id, rank)`` as candidates.  A sample without its answer
    fails.  ``multihop`` marks the examples of the stricter track."""
    joined = samples.join(qa, "source_qa_id", "left")
    missing = F.raise_error(F.concat(F.lit("no answer for sample "), F.col("source_qa_id").cast("string")))
    positives = F.array_distinct("positive_doc_ids")
    rows = joined.select(
        "query_id", "source_qa_id", F.when(F.col("question").isNull(), missing).otherwise(F.col("question")).alias("question"), "answer", positives.alias("positive_doc_ids"),
        F.transform(positives, lambda d, i: F.struct(d.alias("doc_id"), i.alias("hop_index"))).alias("contexts"), (F.size(positives) >= 2).alias("multihop"),
    )
    if negatives is None:
        return rows
    lists = negatives.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("negatives"))
    empty = F.array().cast(rows.schema["positive_doc_ids"].dataType)
    return rows.join(lists, "query_id", "left").withColumn("candidate_doc_ids", F.concat("positive_doc_ids", F.coalesce("negatives", empty))).drop("negatives")


def extractive_examples(contexts: DataFrame, qa: DataFrame, most: int = 6, size: int = 256, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``keep`` holds tables that are read several times; by default it writes them.
    ``contexts(query_id, ctx, doc_id, text, is_positive)`` and ``qa(query_id, question,
    answer)``: passages, the span label of the first method that finds one, and
    ``multihop``: two positives and two positive contexts left in the input."""
    keep = keep or durable(contexts.sparkSession)
    built = keep(answers.build_passages(contexts, most, size))
    exact = answers.exact_spans(built, qa).withColumn("overlap_score", F.lit(1.0))
    rest = qa.join(exact.select("query_id"), "query_id", "left_anti")
    close = answers.overlap_spans(built, rest).withColumn("method", F.lit("best_overlap"))
    label = keep(exact.unionByName(close.select(exact.columns)))
    marked = answers.answer_passages(built, label.select("query_id", "start", "end", F.col("overlap_score").alias("score")))
    origin = contexts.select("query_id", "ctx", "is_positive")
    items = built.select("query_id", "ctx", "doc_id", "chunk_index", "global_start", "global_end").join(marked.drop("global_end"), ["query_id", "ctx", "chunk_index", "global_start"]).join(origin, ["query_id", "ctx"])
    passage = F.struct("global_start", "global_end", "ctx", "doc_id", "chunk_index", "is_positive", "is_answer_passage")
    grouped = items.groupBy("query_id").agg(
        F.array_sort(F.collect_list(passage)).alias("passages"), F.countDistinct(F.when(F.col("is_positive"), F.col("ctx"))).alias("input_context_count")
    )
    in_order = F.array_sort(F.collect_list(F.struct("global_start", "tokens")))
    flat = built.groupBy("query_id").agg(F.flatten(F.transform(in_order, lambda x: x["tokens"])).alias("flat_tokens"))
    positives = contexts.where("is_positive").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("positive_doc_ids"))
    joined = qa.join(grouped, "query_id").join(flat, "query_id").join(positives, "query_id", "left").join(label, "query_id", "left")
    two = (F.size("positive_doc_ids") >= 2) & (F.col("input_context_count") >= 2)
    return joined.select(
        "query_id", "question", "answer", "passages", "flat_tokens", F.coalesce("start", F.lit(0)).alias("start_position"), F.coalesce("end", F.lit(0)).alias("end_position"),
        F.coalesce("method", F.lit("best_overlap")).alias("label_method"), F.coalesce("overlap_score", F.lit(0.0)).alias("overlap_score"), "positive_doc_ids", "input_context_count",
        F.coalesce(two, F.lit(False)).alias("multihop"),
    )


def label_counts(examples: DataFrame) -> DataFrame:
    """One row of counters over extractive examples, for a manifest."""
    methods = [F.count_if(F.col("label_method") == m).alias(m) for m in ("exact", "fragment", "subsequence", "best_overlap")]
    return examples.agg(F.count("*").alias("samples"), *methods, F.count_if(F.col("overlap_score") == 0).alias("zero_overlap"), F.count_if(F.col("input_context_count") < 2).alias("fewer_than_two_contexts"), F.count_if("multihop").alias("multihop"))


#: An encoder of tokens takes (id, text) and gives (id, tokens array<string>, vectors
#: array<array<double>>), a vector for each token.
TokenEncoder = Callable[[DataFrame], DataFrame]


def token_match_scores(predictions: DataFrame, encode: TokenEncoder) -> DataFrame:
    """``predictions(query_id, prediction, reference)``: (query_id, precision, recall, f1) by
    greedy matching of token vectors, each token weighted by how few references hold it:
    ln((references + 1) / (those with it + 1))."""
    sides = {c: encode(predictions.select(F.col("query_id").alias("id"), F.col(c).alias("text"))).select("id", "tokens", "vectors") for c in ("prediction", "reference")}
    n = predictions.agg(F.count("*").alias("n"))
    df = sides["reference"].select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))

    def weighted(side: DataFrame, name: str) -> DataFrame:
        rows = side.select("id", F.posexplode("tokens").alias("at", "token")).join(df, "token", "left").crossJoin(F.broadcast(n))  # one row
        idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))
        lists = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", idf.alias("w")))), lambda x: x["w"]).alias("w"))  # one text's tokens
        joined = side.join(lists, "id", "left")
        return joined.select(F.col("id").alias("query_id"), F.col("vectors").alias(name), F.coalesce("w", F.array().cast("array<double>")).alias(f"{name}_w"))

    both = predictions.select("query_id").join(weighted(sides["prediction"], "p"), "query_id").join(weighted(sides["reference"], "r"), "query_id")
    return both.select("query_id", V.token_match(F.col("p"), F.col("r"), F.col("p_w"), F.col("r_w")).alias("m")).select("query_id", "m.*")


def answer_metrics(predictions: DataFrame, encode: TokenEncoder | None = None) -> DataFrame:
    """``predictions(query_id, prediction, reference)``: one row of means; a null side
    fails, as do unequal lists; no rows give zeros.  ``bertscore_f1`` is the mean F1 of
    token matching with a model's vectors; without an encoder it is null."""
    bad = F.col("prediction").isNull() | F.col("reference").isNull()
    p = F.when(bad, F.raise_error(F.lit("a prediction or reference is missing"))).otherwise(F.col("prediction"))
    rows = predictions.select(evaluation.rouge_l_long(p, F.col("reference")).alias("rouge_l"), evaluation.meteor_exact(p, F.col("reference")).alias("meteor"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    means = rows.agg(F.count("*").alias("num_examples"), mean("rouge_l"), mean("meteor"))
    if encode is None:
        return means.withColumn("bertscore_f1", F.lit(None).cast("double"))
    return means.crossJoin(token_match_scores(predictions, encode).agg(F.avg("f1").alias("bertscore_f1")))  # one row each


def rescore(spark: SparkSession, rankings_path: str, qrels_path: str, cutoffs: tuple[int, ...] = evaluation.CUTOFFS) -> DataFrame:
    """Metrics of saved rankings against saved judgements."""
    rankings = files.flatten_rankings(files.read_jsonl(spark, rankings_path, files.RANKINGS))
    qrels = files.read_qrels(spark, qrels_path)
    audit.require(audit.same_queries(rankings, qrels))
    return evaluation.ranking_metrics(qrels, rankings, cutoffs)


def comparison(runs: DataFrame, invariants: list[str], by: list[str], expected: dict[str, object] | None = None) -> DataFrame:
    """Runs side by side, after checking what they must share."""
    audit.require(audit.varying_columns(runs, invariants, by))
    if expected:
        audit.require(audit.unexpected(runs, expected))
    return runs.orderBy(*by, *[c for c in ("method", "seed") if c in runs.columns and c not in by])


def align_subwords(subwords: DataFrame, tokens: DataFrame) -> DataFrame:
    """``subwords(id, i, start, end)`` and ``tokens(id, t, start, end)`` as character
    offsets: each subword's first overlapping token, null for empty offsets."""
    a, b = subwords.alias("a"), tokens.alias("b")
    overlaps = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    joined = a.where("end > start").join(b, (F.col("a.id") == F.col("b.id")) & overlaps).groupBy(F.col("a.id").alias("id"), F.col("a.i").alias("i")).agg(F.min("b.t").alias("token"))
    return subwords.select("id", "i").join(joined, ["id", "i"], "left")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order; 0 means all."""
    return rows.orderBy(*order).limit(n) if n else rows


def corpus_counts(records: DataFrame) -> DataFrame:
    """Passages by kind; repeated article numbers count each time and once."""
    articles = F.col("section_type") == "article"
    return records.agg(
        F.count("*").alias("passages"), F.count_if(articles).alias("article_passages"), F.countDistinct(F.when(articles, F.col("doc_id"))).alias("distinct_articles"), F.countDistinct("source_file").alias("documents")
    )


def positive_contexts(examples: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, ctx, doc_id, text, is_positive) of examples' candidates."""
    rows = answers.enrich_contexts(examples, corpus).select("query_id", F.inline("contexts"))
    return rows.select("query_id", F.col("hop_index").alias("ctx"), "doc_id", T.text_or_empty(F.col("text")).alias("text"), "is_positive")
