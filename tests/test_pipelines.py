"""Compositions and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.__main__ import main
from trailmark.operators import answers
from trailmark.plans import pipelines
from trailmark.sources import files


def test_abstractive_examples(spark):
    samples = spark.createDataFrame([("q", "s", ["a", "b", "a"]), ("r", "t", ["c"])], "query_id string, source_qa_id string, positive_doc_ids array<string>")
    qa = spark.createDataFrame([("s", "Q?", "A"), ("t", "R?", "B")], "source_qa_id string, question string, answer string")
    negatives = spark.createDataFrame([("q", "y", 2), ("q", "x", 1)], "query_id string, doc_id string, rank long")
    rows = {r["query_id"]: r for r in pipelines.abstractive_examples(samples, qa, negatives).collect()}
    assert rows["q"]["candidate_doc_ids"] == ["a", "b", "x", "y"] and rows["q"]["multihop"]
    assert [tuple(c) for c in rows["q"]["contexts"]] == [("a", 0), ("b", 1)]
    assert rows["r"]["candidate_doc_ids"] == ["c"] and not rows["r"]["multihop"]
    with pytest.raises(Exception, match="no answer"):
        pipelines.abstractive_examples(samples, qa.where("source_qa_id = 's'")).collect()


def test_extractive_examples(spark):
    contexts = spark.createDataFrame(
        [("q", 0, 1, "the law says yes", True), ("q", 1, 2, "another text", True), ("q", 2, 3, "noise", False), ("r", 0, 4, "alpha beta", True), ("s", 0, 5, "", True)],
        "query_id string, ctx int, doc_id long, text string, is_positive boolean",
    )
    qa = spark.createDataFrame([("q", "?", "law says"), ("r", "?", "beta gamma"), ("s", "?", "x")], "query_id string, question string, answer string")
    examples = pipelines.extractive_examples(contexts, qa)
    rows = {r["query_id"]: r for r in examples.collect()}
    assert (rows["q"]["start_position"], rows["q"]["end_position"], rows["q"]["label_method"]) == (1, 2, "exact")
    assert rows["q"]["multihop"] and [p["is_answer_passage"] for p in rows["q"]["passages"]] == [True, False, False]
    assert rows["r"]["label_method"] == "best_overlap" and 0 < rows["r"]["overlap_score"] < 1 and not rows["r"]["multihop"]
    counts = pipelines.label_counts(examples).first()
    assert (counts["samples"], counts["exact"], counts["best_overlap"], counts["multihop"]) == (2, 1, 1, 1)


def test_answer_metrics(spark):
    rows = spark.createDataFrame([("a", "x y", "x y"), ("b", "", "z")], "query_id string, prediction string, reference string")
    got = pipelines.answer_metrics(rows).first()
    assert (got["num_examples"], got["rouge_l"], got["meteor"], got["bertscore_f1"]) == (2, 0.5, 0.5, None)
    assert pipelines.answer_metrics(rows.where("false")).first()["rouge_l"] == 0.0
    with pytest.raises(Exception, match="missing"):
        pipelines.answer_metrics(rows.withColumn("reference", F.lit(None).cast("string"))).collect()


def test_comparison_checks_invariants(spark):
    runs = spark.createDataFrame([("m", 1, "h", "dev"), ("n", 1, "h", "dev")], "method string, seed int, corpus string, split string")
    assert pipelines.comparison(runs, ["corpus"], ["split"], {"seed": 1}).count() == 2
    with pytest.raises(ValueError):
        pipelines.comparison(runs.withColumn("corpus", F.col("method")), ["corpus"], ["split"])
    with pytest.raises(ValueError):
        pipelines.comparison(runs, ["corpus"], ["split"], {"seed": 2})


def test_alignment(spark):
    subwords = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 2), (1, 2, 2, 5), (1, 3, 9, 10)], "id int, i int, start int, end int")
    tokens = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 6)], "id int, t int, start int, end int")
    got = {r["i"]: r["token"] for r in pipelines.align_subwords(subwords, tokens).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: None}


def test_positive_contexts(spark):
    docs = spark.createDataFrame([(1, "t", "x"), (2, "t", None)], "doc_id long, title string, text string")
    examples = spark.createDataFrame([("q", [2, 1], [1])], "query_id string, candidate_doc_ids array<long>, positive_doc_ids array<long>")
    with pytest.raises(Exception, match="missing"):
        pipelines.positive_contexts(examples, docs).collect()
    built = answers.build_passages(pipelines.positive_contexts(examples, docs.fillna("")))
    assert [r["ctx"] for r in built.collect()] == [1]


def test_command_line(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    passages = [{"doc_id": "d1", "title": "", "text": "alpha bravo."}, {"doc_id": "d2", "title": "", "text": "bravo charlie."}, {"doc_id": "d3", "title": "", "text": "delta"}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, passages)))
    (tmp_path / "queries.jsonl").write_text(json.dumps({"query_id": "q", "query": "alpha", "positive_doc_ids": ["d1"]}))
    (tmp_path / "qrels.tsv").write_text("q\t0\td1\t1\nq\t0\td2\t1\n")
    main(["validate", "--corpus", at("corpus.jsonl"), "--queries", at("queries.jsonl"), "--qrels", at("qrels.tsv")], spark)
    for method in ("bm25", "hops", "m3"):  # m3 fuses dense hops, so it ranks every passage
        main(["retrieve", "--corpus", at("corpus.jsonl"), "--queries", at("queries.jsonl"), "--output", at(method), "--method", method], spark)
    assert [r["doc_id"] for r in files.read_jsonl(spark, at("m3/rankings"), files.RANKINGS).first()["results"]][0] == "d1"
    nested = files.read_jsonl(spark, at("hops/rankings"), files.RANKINGS).first()
    assert nested["results"][0]["doc_id"] == "d1" and {r["doc_id"] for r in nested["results"]} == {"d1", "d2"}
    main(["evaluate", "--rankings", at("bm25/rankings"), "--qrels", at("qrels.tsv"), "--output", at("metrics")], spark)
    row = spark.read.csv(at("metrics"), sep="\t", header=True).where("k = 5").first()
    assert float(row["recall"]) == 0.5
    main(["tracks", "--qrels", at("qrels.tsv"), "--output", at("track")], spark)
    assert files.read_qrels(spark, at("track")).count() == 2
    (tmp_path / "qa.json").write_text(json.dumps({"s": {"question": "q", "answer": "a", "contexts": {"1": {"content": "x"}, "2": {"content": "y"}}}, "t": {"question": "q", "answer": "a", "contexts": {}}}))
    main(["filter-multihop", "--input", at("qa.json"), "--output", at("multi")], spark)
    assert spark.read.json(at("multi")).count() == 1
    (tmp_path / "pred.jsonl").write_text(json.dumps({"query_id": "q", "prediction": "a", "reference": "a"}))
    main(["evaluate-answers", "--predictions", at("pred.jsonl"), "--output", at("answers")], spark)
    assert json.loads(spark.read.text(at("answers")).first()[0])["rouge_l"] == 1.0
    (tmp_path / "runs.jsonl").write_text(json.dumps({"method": "m", "seed": 1, "metric": "x", "value": 1.0}))
    main(["summarize", "--runs", at("runs.jsonl"), "--output", at("summary")], spark)
    assert spark.read.csv(at("summary"), sep="\t", header=True).count() == 1
    with pytest.raises(SystemExit):
        main(["retrieve", "--corpus", "x", "--queries", "x", "--output", "x", "--top-k", "200"], spark)


def test_readers(spark):
    from trailmark.plans import readers

    assert [readers.model_family(n) for n in ("x/mBART-50", "bartpho", "ViT5", "google/mt5", "other")] == ["mbart", "bartpho", "vit5", "mt5", "generic"]
    assert readers.greedy_settings("mt5") == {"num_beams": 1, "do_sample": False}
    assert readers.greedy_settings("mbart", {"vi_VN": 7})["forced_bos_token_id"] == 7
    with pytest.raises(ValueError):
        readers.greedy_settings("mbart", {})
    rows = spark.createDataFrame([("q", "which law", " A ", [("d", "T", "No match. The law here.")])], "query_id string, question string, answer string, contexts array<struct<doc_id:string,title:string,text:string>>")
    row = readers.predict(rows, "msg", readers.extractive_reader).first()
    assert row["prediction"].startswith("The law here.") and row["reference"] == "A"
    with pytest.raises(Exception, match="empty"):
        readers.predict(rows.withColumn("answer", F.lit(" ")), "msg", readers.extractive_reader).collect()
