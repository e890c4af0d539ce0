"""The stages of an experiment, from files to files.

Every table carries ``split`` as a partition column, so a stage handles all splits
in one pass and a reader of one split opens only its files.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, audit, corpus, dense, docids, evaluation, lexical, multihop
from ..session import durable, shared_dir
from ..sources import files
from ..sources.lexical_store import CONTENT, open_index
from . import pipelines, readers

#: The tracks of an experiment.
TRACKS = ("all_matched", "true_multihop")
PASSAGES = "doc_id string, text string, title string, url string, source_file string, section_type string, section_number string"
SAMPLES = "query_id string, query string, positive_doc_ids array<string>, source_qa_id string, source_context_count long, structured_context_count long, source_context_refs array<string>"


def _fail_if(bad: Column, value: Column, message: str, name: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(message), name))).otherwise(value)


def read_qa(spark: SparkSession, folder: str) -> DataFrame:
    """(split, source_qa_id, question, answer, contexts in order) of ``{split}_multihop.json``."""
    rows = files.read_object_file(spark, f"{folder.rstrip('/')}/*_multihop.json")
    return rows.select(F.regexp_extract("file", r"([^/]+)_multihop\.json$", 1).alias("split"), F.col("key").alias("source_qa_id"), "value.question", "value.answer", F.map_values("value.contexts").alias("contexts"))


def _samples_with_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """QA samples with ``sample_id``; one with fewer than two contexts fails."""
    qa = read_qa(spark, folder)
    few = F.coalesce(F.size("contexts"), F.lit(0)) < 2
    return qa.withColumn("sample_id", _fail_if(few, F.concat_ws("_", "split", "source_qa_id"), "fewer than two contexts: ", F.col("source_qa_id")))


def _structured(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return files.structured_documents(files.read_tree(spark, folder), corpus.STRUCTURE_KINDS)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)


def _write_set(samples: DataFrame, records: DataFrame, output: str) -> None:
    """Samples, their passages and judgements."""
    _write(samples, f"{output}/samples")
    _write(records, f"{output}/corpus")
    judged = samples.select("split", "query_id", F.explode("positive_doc_ids").alias("doc_id"), F.lit(1).alias("gain"))
    files.write_qrels(judged, f"{output}/qrels", "overwrite", partition="split")


def create_from_structured(spark: SparkSession, input_dir: str, structured_dir: str, output: str) -> None:
    """QA samples whose references all resolve to structured documents, with a passage
    for each reference; the others with the links that did not."""
    documents, rejected = _structured(spark, structured_dir)
    qa = _samples_with_contexts(spark, input_dir)
    refs = qa.select("sample_id", "split", F.posexplode("contexts").alias("pos", "c")).withColumn("ref_id", F.concat_ws("\x1f", "sample_id", F.col("pos").cast("string")))
    resolved = corpus.resolve_references(refs.select("ref_id", F.coalesce("c.link", F.lit("")).alias("url")), documents.select(F.col("path").alias("doc_id"), "stem"))
    number = F.col("c.`điều`")
    passage = F.concat("path", F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("#dieu="), number)).otherwise(F.lit("#document")))
    keep = durable(spark, f"{output}/_work")
    found = keep(refs.join(resolved.select("ref_id", F.col("doc_id").alias("path")), "ref_id").withColumn("doc_id", passage))
    kept, dropped = corpus.all_or_nothing(found.select("sample_id", "pos", F.coalesce("c.link", F.lit("")).alias("url"), "doc_id"))
    size = F.size("contexts").cast("long")
    refs_of = F.array_distinct(F.transform("contexts", lambda c: c["content"])).alias("source_context_refs")
    samples = kept.join(qa, "sample_id").select(
        "split", F.col("sample_id").alias("query_id"), T.text_or_empty(F.col("question")).alias("query"), F.col("doc_ids").alias("positive_doc_ids"), "source_qa_id",
        size.alias("source_context_count"), size.alias("structured_context_count"), refs_of,
    )
    asked = found.join(kept.select("sample_id"), "sample_id", "left_semi")
    first = asked.groupBy("split", "doc_id").agg(F.min_by(F.struct("path", number.alias("article"), F.col("c.document").alias("title"), F.coalesce("c.link", F.lit("")).alias("url")), F.struct("sample_id", "pos")).alias("r"))
    requests = first.select("split", F.col("r.path").alias("source_id"), "r.article", "r.title", "r.url").join(documents.select(F.col("path").alias("source_id"), "path", "stem", "header", "sections"), "source_id")
    records = corpus.passage_records(requests.withColumn("title", F.coalesce("title", "stem")), "split")
    _write_set(keep(samples), records, output)
    _write(dropped.join(qa.select("sample_id", "split", "source_qa_id"), "sample_id").select("split", "source_qa_id", "reason", "missing_links"), f"{output}/dropped")
    files.write_jsonl(rejected, f"{output}/rejected", "overwrite")


def create_samples(spark: SparkSession, input_dir: str, contexts_dir: str, output: str) -> None:
    """QA samples whose contexts name files of their own; a file that is missing fails."""
    qa = _samples_with_contexts(spark, input_dir)
    rows = qa.select("sample_id", "split", F.posexplode("contexts").alias("pos", "c"))
    whole = F.from_json(F.to_json("c"), "map<string,string>")
    rows = rows.withColumn("doc_id", T.synthetic_id(F.col("c.content"), whole)).withColumn("ref", F.trim(T.text_or_empty(F.col("c.content"))))
    first = rows.groupBy("split", "doc_id").agg(F.min_by(F.struct("ref", "c"), F.struct("sample_id", "pos")).alias("r")).select("split", "doc_id", "r.ref", "r.c")
    tree = files.read_tree(spark, contexts_dir, "*").select(F.col("path").alias("stem"), "value")
    held = files.lookup_contexts(first, tree).withColumn("file", F.from_json("value", files.CONTEXT_FILE))
    records = held.select(
        "split", "doc_id", T.text_or_empty(F.col("file.passage")).alias("text"), F.coalesce("file.name", "c.document", F.lit("")).alias("title"), F.coalesce("file.link", "c.link", F.lit("")).alias("url"),
        F.col("ref").alias("source_file"), F.lit("context").alias("section_type"), F.lit(None).cast("string").alias("section_number"),
    )
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]))
    ids = rows.groupBy("sample_id").agg(ordered.alias("positive_doc_ids"))
    samples = qa.join(ids, "sample_id").select("split", F.col("sample_id").alias("query_id"), T.text_or_empty(F.col("question")).alias("query"), "positive_doc_ids", "source_qa_id")
    _write_set(samples, records, output)


def prepare(spark: SparkSession, ir_dir: str, structured_dir: str, output: str) -> None:
    """One corpus for all splits: every numbered article, whole documents without any, and
    the passages that samples ask for, which win; then both tracks' queries and
    judgements, checked against it, and a manifest of counts."""
    gold = files.read_jsonl(spark, f"{ir_dir}/corpus", PASSAGES)
    columns = [c for c in gold.columns if c != "split"]
    order = F.expr("array_position(array('train', 'dev', 'test'), split)")
    filled = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(order, F.col("doc_id")))).alias(c)
    meta = gold.groupBy("source_file").agg(filled("title"), filled("url"))
    documents, _ = _structured(spark, structured_dir)
    named = documents.join(meta.withColumnRenamed("source_file", "path"), "path", "left")
    named = named.withColumn("title", corpus.first_filled(F.col("title"), F.col("header"), F.col("stem"))).withColumn("url", T.text_or_empty(F.col("url")))
    numbers = F.array_distinct(F.transform(F.filter("sections", lambda s: (s["kind"] == corpus.ARTICLE) & s["number"].isNotNull()), lambda s: s["number"]))
    wanted = named.withColumn("article", F.explode(F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(None).cast("string")))))
    own = corpus.passage_records(wanted).where(F.trim("text") != "")
    every = corpus.global_corpus(own.select(*columns, F.lit(0).alias("pos")), gold.select(*columns, order.alias("pos"))).drop("pos")
    files.write_jsonl(every, f"{output}/corpus", "overwrite")
    passages = files.read_jsonl(spark, f"{output}/corpus", PASSAGES)
    samples = files.read_jsonl(spark, f"{ir_dir}/samples", SAMPLES)
    qrels = files.read_qrels(spark, f"{ir_dir}/qrels")
    counts = [pipelines.corpus_counts(passages).select(F.lit("corpus").alias("track"), F.lit("").alias("split"), F.to_json(F.struct("*")).alias("counts"))]
    for track in TRACKS:
        judged = corpus.filter_track(qrels, track)
        asked = samples.join(judged.select("query_id").distinct(), "query_id", "left_semi")
        audit.require(audit.validate(asked, judged, passages))
        _write(asked, f"{output}/{track}/queries")
        files.write_qrels(judged, f"{output}/{track}/qrels", "overwrite", partition="split")
        relevant = judged.groupBy("split", "query_id").agg(F.count("*").alias("n"), F.count_if(F.col("gain") > 0).alias("p")).groupBy("split")
        numbers_ = relevant.agg(F.count("*").alias("queries"), F.sum("n").alias("qrels"), F.count_if(F.col("p") >= 2).alias("queries_with_2plus_positives"))
        counts.append(numbers_.select(F.lit(track).alias("track"), "split", F.to_json(F.struct("queries", "qrels", "queries_with_2plus_positives")).alias("counts")))
    manifest = counts[0]
    for one in counts[1:]:
        manifest = manifest.unionByName(one)
    files.write_manifest(manifest.orderBy("track", "split"), f"{output}/manifest")


def _inputs(spark: SparkSession, qa_dir: str, ir_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples = files.read_jsonl(spark, f"{ir_dir}/samples", SAMPLES)
    qa = read_qa(spark, qa_dir).select("source_qa_id", "split", "question", "answer")
    return samples, qa, files.read_jsonl(spark, f"{ir_dir}/corpus", PASSAGES)


def _negatives(samples: DataFrame, qa: DataFrame, passages: DataFrame, n: int, seed: int, find: Callable) -> DataFrame | None:
    """(query_id, doc_id, rank): within each split, filled up by a seeded order.  A split's
    passages are an index of their own, since its counts and lengths are."""
    asked = samples.join(qa, ["source_qa_id", "split"]).select("split", "query_id", F.col("question").alias("text"), "positive_doc_ids")
    out = None
    for (split,) in asked.select("split").distinct().collect() if n else []:  # a few splits
        q, p = asked.where(F.col("split") == split), passages.where(F.col("split") == split)
        positives = q.select("query_id", F.explode("positive_doc_ids").alias("doc_id"))
        found = lexical.backfill(find(q, p, positives, n), q, p, positives, n, seed).select("query_id", "doc_id", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def _write_tracks(rows: DataFrame, output: str) -> None:
    _write(rows.drop("multihop"), f"{output}/all_matched")
    _write(rows.where("multihop").drop("multihop"), f"{output}/true_multihop")


def prepare_abstractive(spark: SparkSession, qa_dir: str, ir_dir: str, output: str, distractors: int = 0, seed: int = 42) -> None:
    """Examples of both tracks; with distractors, candidates are the positives and the best
    Okapi-scored others."""
    samples, qa, passages = _inputs(spark, qa_dir, ir_dir)
    negatives = _negatives(samples, qa, passages, distractors, seed, lexical.okapi_negatives)
    named = lambda df: df.withColumn("source_qa_id", F.concat_ws("\x1f", "split", "source_qa_id"))
    keep = durable(spark, f"{output}/_work")
    rows = pipelines.abstractive_examples(named(samples), named(qa).drop("split"), negatives if negatives is None else keep(negatives))
    counts = samples.select("query_id", "split", "source_context_count", "structured_context_count")
    rows = keep(rows.join(counts, "query_id").withColumn("source_qa_id", F.element_at(F.split("source_qa_id", "\x1f"), -1)))
    _write_tracks(rows, output)
    files.write_manifest(rows.groupBy("split").agg(F.count("*").alias("all_matched"), F.count_if("multihop").alias("true_multihop")).orderBy("split"), f"{output}/manifest")


def prepare_extractive(spark: SparkSession, qa_dir: str, ir_dir: str, structured_dir: str, output: str, most: int = 6, size: int = 256, distractors: int = 0, seed: int = 42) -> None:
    """Passages and span labels; of a whole-document context the article that shares most
    with the question stands for it."""
    keep = durable(spark, f"{output}/_work")
    samples, qa, passages = _inputs(spark, qa_dir, ir_dir)
    overlap = lambda q, p, positives, n: lexical.overlap_negatives(q, lexical.build_index(p), positives, n)
    negatives = _negatives(samples, qa, passages, distractors, seed, overlap)
    own = samples.select("query_id", "split", F.posexplode(F.array_distinct("positive_doc_ids")).alias("ctx", "doc_id")).withColumn("is_positive", F.lit(True))
    if negatives is not None:
        at = samples.select("query_id", "split", F.size(F.array_distinct("positive_doc_ids")).alias("n"))
        own = own.unionByName(negatives.join(at, "query_id").select("query_id", "split", (F.col("n") + F.col("rank") - 1).cast("int").alias("ctx"), "doc_id", F.lit(False).alias("is_positive")))
    held = own.join(passages.select("split", "doc_id", "title", "text", "source_file", F.lit(True).alias("held")), ["split", "doc_id"], "left")
    held = held.withColumn("text", _fail_if(F.col("held").isNull(), F.col("text"), "document missing from the corpus: ", F.col("doc_id")))
    asked = samples.join(qa, ["source_qa_id", "split"], "left").withColumn("question", _fail_if(F.col("question").isNull(), F.col("question"), "no answer for sample ", F.col("source_qa_id")))
    documents, _ = _structured(spark, structured_dir)
    articles = documents.select(F.col("path").alias("doc_id"), F.posexplode(F.filter("sections", lambda s: (s["kind"] == corpus.ARTICLE) & s["number"].isNotNull())).alias("pos", "s")).select("doc_id", "pos", "s.number", "s.title")
    whole = held.where(F.col("doc_id").endswith("#document")).join(asked.select("query_id", "question"), "query_id")
    contexts = whole.select(F.struct("query_id", "ctx").alias("ctx_id"), F.col("source_file").alias("doc_id"), "question")
    related = corpus.related_sections(contexts, articles).select(F.col("ctx_id.query_id").alias("query_id"), F.col("ctx_id.ctx").alias("ctx"), F.concat("doc_id", F.lit("#dieu="), "number").alias("near_id"), F.col("text").alias("near_text"))
    rows = held.join(related, ["query_id", "ctx"], "left").select("query_id", "ctx", F.coalesce("near_id", "doc_id").alias("doc_id"), T.text_or_empty(F.coalesce("near_text", "text")).alias("text"), "is_positive")
    examples = pipelines.extractive_examples(keep(rows), keep(asked.select("query_id", "question", "answer")), most, size, keep).drop("positive_doc_ids", "multihop")
    known = samples.select("query_id", "split", "source_qa_id", F.array_distinct("positive_doc_ids").alias("positive_doc_ids"), "source_context_count", "structured_context_count")
    full = keep(examples.join(known, "query_id").withColumn("multihop", (F.size("positive_doc_ids") >= 2) & (F.col("input_context_count") >= 2)))
    _write_tracks(full, output)
    counted = [pipelines.label_counts(full.where(F.col("split") == s)).withColumn("split", F.lit(s)) for (s,) in samples.select("split").distinct().collect()]
    manifest = counted[0]
    for one in counted[1:]:
        manifest = manifest.unionByName(one)
    files.write_manifest(manifest.orderBy("split"), f"{output}/manifest")


METHODS = ("bm25", "dense", "hybrid", "mdr", "m3", "mopo", "baleen", "gmr", "ircot", "hops")
#: An encoder takes (id, text) and the id's name and gives (id, v).
Encoder = Callable[[DataFrame, str], DataFrame]
#: A generator takes queries (query_id, text) and ids (doc_id, tokens) and gives a scorer.
Generator = Callable[[DataFrame, DataFrame], docids.Scorer]
#: The tokens between generated ids and behind the last one.
SEPARATOR, END = 1, 2


def rank(
    method: str, queries: DataFrame, passages: DataFrame, depth: int = 100, hops: int = 3, encode: Encoder = dense.hashed_vectors, fold: str = "none", store: str | None = None,
    generate: Generator | None = None, beams: int = 1, steps: int = 256,
) -> DataFrame:
    """(query_id, doc_id, score, rank) by any method.  ``encode`` and ``generate`` are where
    models plug in; the defaults are a hash of the words, and spelling out the ids of the
    lexical ranking.  Index and vectors are kept below ``store`` and used again as long
    as the passages are the same."""
    columns = ["query_id", "doc_id", "score", "rank"]
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    spark = queries.sparkSession
    keep = durable(spark)
    root = store or f"{shared_dir(spark)}/trailmark/store-{uuid.uuid4().hex}"
    if method in ("bm25", "hybrid", "ircot", "hops") or method == "gmr" and generate is None:
        index = open_index(passages, f"{root}/lexical-{fold}", fold)
        search = lambda q: lexical.bm25(q, index, depth).select(*columns)
    if method == "bm25":
        return search(queries)
    if method == "gmr":
        ids = keep(passages.select("doc_id", docids.byte_tokens(F.col("doc_id").cast("string")).alias("tokens")))
        scorer = generate(queries, ids) if generate else docids.spelled(keep(search(queries)), ids, SEPARATOR, END)
        best = docids.decode(queries, docids.trie_edges(ids), scorer, SEPARATOR, END, beams, steps, keep).where("beam = 1")
        return docids.resolve_ids(docids.decoded_ids(best, ids, SEPARATOR, END), ids).select(*columns)
    if method == "ircot":
        return multihop.interleaved_reasoning(queries, search, passages, hops, depth=depth, keep=keep).select(*columns)
    if method == "hops":
        return multihop.fuse_hops(multihop.greedy_hops(queries, search, passages, hops, keep=keep), depth=depth).select(*columns)
    name = files.config_key(encoder=getattr(encode, "__qualname__", repr(encode)), corpus=audit.table_fingerprint(passages, CONTENT).first()["digest"])
    vectors = files.ensure_vectors(spark, passages, lambda rows: encode(rows, "doc_id").withColumnRenamed("v", "embedding"), f"{root}/vectors", name).withColumnRenamed("embedding", "v")
    near = lambda q: dense.dense_search(encode(q, "query_id"), vectors, depth).select(*columns)
    if method == "dense":
        return near(queries)
    if method == "hybrid":
        return dense.hybrid(near(queries), search(queries), depth).select(*columns)
    parts = lambda df, name: df.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", (i * F.size("v") / 4).cast("int") + 1, (F.size("v") / 4).cast("int")).cast("array<double>"))).drop("v")
    rerank = (lambda ranked, asked: dense.maxsim_rerank(ranked, parts(encode(asked, "query_id"), "q"), parts(vectors, "d"))) if method == "baleen" else None
    return multihop.fuse_hops(multihop.greedy_hops(queries, near, passages, hops, rerank=rerank, keep=keep), method, depth).select(*columns)


def retrieval_run(
    method: str, queries: DataFrame, passages: DataFrame, output: str, qrels: DataFrame | None = None, top_k: int = 100, depth: int = 100, hops: int = 3, encode: Encoder = dense.hashed_vectors,
    fold: str = "none", store: str | None = None, **own: object,
) -> None:
    """Rankings of ``queries(query_id, text)`` in ``output/rankings``, a query without hits
    among them, and one row of metrics in ``output/metrics``: scores against
    ``qrels``, if given, which must judge the same queries; ``own`` facts of the run;
    fingerprints of what it read; the seconds that it took."""
    begun = time.perf_counter()
    spark = queries.sparkSession
    nested = files.nest_rankings(rank(method, queries, passages, depth, hops, encode, fold, store).where(F.col("rank") <= top_k))
    none = F.array().cast(nested.schema["results"].dataType)
    files.write_jsonl(queries.select("query_id").join(nested, "query_id", "left").select("query_id", F.coalesce("results", none).alias("results")), f"{output}/rankings", "overwrite")
    ranked = files.read_jsonl(spark, f"{output}/rankings", files.RANKINGS)
    row: dict[str, object] = {**own, "method": method, "top_k": top_k, "search_depth": depth, "max_hops": hops, "model": getattr(encode, "__qualname__", repr(encode)) if method not in ("bm25", "ircot", "hops", "gmr") else None}
    row["corpus_fingerprint"] = audit.table_fingerprint(passages, CONTENT).first()["digest"]
    row["queries_fingerprint"] = audit.table_fingerprint(queries, ["query_id", "text"]).first()["digest"]
    if qrels is not None:
        audit.require(audit.same_queries(ranked, qrels))
        row["qrels_fingerprint"] = audit.table_fingerprint(qrels, ["query_id", "doc_id", "gain"]).first()["digest"]
        for m in evaluation.ranking_metrics(qrels, files.flatten_rankings(ranked), tuple(sorted({*evaluation.CUTOFFS, top_k}))).collect():  # a row for each cutoff
            row["num_queries"] = m["num_queries"]
            row |= {f"{name}@{m['k']}": m[name] for name in ("recall", "mrr", "ndcg", "map", "complete_evidence")}
    row["results_per_query_mean"] = ranked.agg(F.round(F.coalesce(F.avg(F.size("results")), F.lit(0.0)), 4)).first()[0]
    row["runtime_seconds"] = round(time.perf_counter() - begun, 3)
    files.write_manifest(spark.createDataFrame([row], _row_schema(row)), f"{output}/metrics")


def _row_schema(row: dict[str, object]) -> str:
    kinds = {int: "long", float: "double", bool: "boolean"}
    return ", ".join(f"`{k}` {kinds.get(type(v), 'string')}" for k, v in row.items())


def evaluate_reader(
    queries: DataFrame, rankings: DataFrame, passages: DataFrame, qa: DataFrame, k: int = 10, method: str = "pathfid", reader: readers.Reader = readers.extractive_reader, max_source: int = 2048,
    max_passage: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """``queries(query_id, text)`` with ``rankings(query_id, results)`` through a reader:
    predictions, and one row of metrics.  Passages are cut so that ``k`` of them fit a
    prompt of ``max_source`` tokens.  A query without a ranking fails."""
    lacking = queries.join(rankings.select("query_id"), "query_id", "left_anti").select(F.lit("query without ranking").alias("problem"), F.col("query_id").cast("string").alias("id"))
    audit.require(lacking)
    examples = answers.downstream_examples(queries, files.flatten_rankings(rankings), passages, qa, k)
    none = F.array().cast(examples.schema["contexts"].dataType)
    keep = durable(queries.sparkSession)
    examples = keep(examples.withColumn("contexts", F.coalesce("contexts", none)))
    budget = answers.passage_budget(k, max_source, max_passage)
    predictions = keep(readers.predict(examples, method, reader, k, budget))
    facts = examples.agg(F.round(F.avg(F.size("contexts")), 4).alias("mean_retrieved_contexts")).withColumn("max_passage_tokens", F.lit(budget))
    return predictions, pipelines.answer_metrics(predictions).crossJoin(F.broadcast(facts))  # one row each


def reader_run(
    samples: DataFrame, rankings: DataFrame, passages: DataFrame, qa: DataFrame, output: str, k: int = 10, method: str = "pathfid", max_source: int = 2048, max_passage: int = 256,
    reader: readers.Reader = readers.extractive_reader, **own: object,
) -> None:
    """A reader's predictions for ``samples`` in ``output/predictions``, and one row of
    metrics, with fingerprints of rankings and queries, in ``output/metrics``."""
    asked = samples.join(qa.select("split", "source_qa_id", "question", "answer"), ["split", "source_qa_id"], "left")
    queries = asked.select("query_id", F.coalesce("question", F.lit("")).alias("text"))
    predictions, means = evaluate_reader(queries, rankings, passages, asked, k, method, reader, max_source, max_passage)
    files.write_jsonl(predictions, f"{output}/predictions", "overwrite")
    facts = {**own, "reader_checkpoint": "extractive stand-in" if reader is readers.extractive_reader else "", "reader_method": method, "reader_model_name": "", "top_k_contexts": k}
    facts["rankings_fingerprint"] = audit.table_fingerprint(rankings.withColumn("results", F.to_json("results")), ["query_id", "results"]).first()["digest"]
    facts["queries_fingerprint"] = audit.table_fingerprint(samples, ["query_id", "query"]).first()["digest"]
    files.write_manifest(means.select(*[F.lit(v).alias(c) for c, v in facts.items()], "*"), f"{output}/metrics")


def evaluate_spans(logits: DataFrame, examples: DataFrame, top: int = 20, longest: int = 512) -> tuple[DataFrame, DataFrame]:
    """``logits(id, passage, position, start_logit, end_logit)`` of a span model and
    ``examples(query_id, flat_tokens, answer)``: predictions, and one row of metrics.  An
    example without any span predicts its first token."""
    spans = evaluation.decode_spans(logits, top, longest).select(F.col("id").alias("query_id"), "span_start", "span_end")
    at = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = examples.join(spans, "query_id", "left").withColumn("predicted_start", at("span_start")).withColumn("predicted_end", at("span_end"))
    text = T.detokenize(F.slice("flat_tokens", (F.col("predicted_start") + 1).cast("int"), (F.col("predicted_end") - F.col("predicted_start") + 1).cast("int")))
    predictions = joined.select("query_id", text.alias("prediction"), F.col("answer").alias("reference"), "predicted_start", "predicted_end")
    return predictions, pipelines.answer_metrics(predictions)


#: What runs of one split must share, and what may differ between runs.
QA_SHARED = ["reader_checkpoint", "reader_method", "reader_model_name", "queries_fingerprint", "num_examples", "max_passage_tokens"]
IR_SHARED = ["corpus_fingerprint", "qrels_fingerprint", "queries_fingerprint", "search_depth", "track", "split"]
RUN_OWN = ("method", "seed", "trainable_parameters")


def summarize_readers(runs: DataFrame, expected: dict[str, object] | None = None) -> DataFrame:
    """Reader runs side by side, by split, after checking what they must share."""
    return pipelines.comparison(runs, [c for c in QA_SHARED if c in runs.columns], ["split"], expected)


#: The columns of the tables of reader and of retrieval runs.
QA_TABLE = ["split", "retrieval_method", "retrieval_seed", "num_examples", "top_k_contexts", "mean_retrieved_contexts", "rouge_l", "meteor", "bertscore_f1"]
IR_TABLE = ["split", "method", "seed", "num_queries", "recall@1", "recall@5", "recall@10", "recall@20", "recall@100", "mrr@10", "ndcg@10", "map@10", "complete_evidence@100", "results_per_query_mean"]


def summarize_runs(runs: DataFrame, expected: dict[str, object] | None = None) -> DataFrame:
    """Retrieval runs side by side, by split, after checking what they must share."""
    return pipelines.comparison(runs, [c for c in IR_SHARED if c in runs.columns], ["split"], expected)


def summarize_extractive(args: DataFrame, complete: DataFrame, metrics: DataFrame, expected: dict[str, object] | None = None) -> DataFrame:
    """``args(run, method, seed, name, value)``: the settings of every run;
    ``complete(run)``: runs that ended; ``metrics(run, split, method, seed, num_examples,
    data, metric, value)``.  (split, method, metric, n, mean, std) if every run ended, all
    share their settings and each split its data and number of examples."""
    ended = args.select("run").distinct().join(complete, "run", "left_anti").select(F.lit("run is not complete").alias("problem"), F.col("run").alias("id"))
    audit.require(ended)
    shared = args.where(~F.col("name").isin(*RUN_OWN))
    n = args.select("run").distinct().count()
    differ = shared.groupBy("name").agg(F.countDistinct(F.coalesce("value", F.lit("∅"))).alias("values"), F.countDistinct("run").alias("runs"))
    audit.require(differ.where((F.col("values") > 1) | (F.col("runs") < n)).select(F.lit("runs do not share").alias("problem"), "name"))
    if expected:
        wanted = args.sparkSession.createDataFrame([(k, str(v)) for k, v in expected.items()], "name string, want string")
        audit.require(wanted.join(shared.select("name", "value").distinct(), "name", "left").where(~F.col("value").eqNullSafe(F.col("want"))).select("name", "want", "value"))
    audit.require(audit.varying_columns(metrics, ["num_examples", "data"], ["split"]))
    parts = [audit.summarize_seeds(metrics.where(F.col("split") == s)).withColumn("split", F.lit(s)) for (s,) in metrics.select("split").distinct().orderBy("split").collect()]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out.select("split", "method", "metric", "n", "mean", "std")
