"""Every command from input files to outputs."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from trailmark.__main__ import main
from trailmark.operators import answers
from trailmark.plans import experiments, readers, stages
from trailmark.sources import files


def laws():
    return {
        "sub+(x)/labour-law-10.json": {"Header": "Labour law", "Điều": [{"number": 1, "title": "Leave\nWorkers have twelve days of leave."}, {"number": 2, "title": "Pay\nWages are paid monthly."}]},
        "land-law-20.json": {"Header": "Land law", "Điều": [{"number": 5, "title": "Use\nLand use needs a permit."}]},
        "plain-30.json": {"Header": "Plain rules", "Chương": ["All rules are plain."]},
    }


def sample(question, answer, *contexts):
    return {"question": question, "answer": answer, "contexts": {str(i): {"content": f"c{i}.json", "link": link, "document": name, "điều": article} for i, (link, name, article) in enumerate(contexts)}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    for path, value in laws().items():
        (base / "laws" / path).parent.mkdir(parents=True, exist_ok=True)
        (base / "laws" / path).write_text(json.dumps(value, ensure_ascii=False))
    labour, land, plain = "https://x/labour-law-10.html", "https://x/land-law-20.aspx", "https://x/plain-30.html"
    qa = {
        "train": {"1": sample("How many days of leave", "twelve days of leave", (labour, "Labour", "1"), (land, "Land", "5"))},
        "dev": {
            "7": sample("When are wages paid", "Wages are paid monthly.", (labour, "", "2"), (plain, "Plain", None), (labour, "", "2")),
            "8": sample("Land permit", "a permit", (land, "Land", "99"), (land, "Land", "5")),
            "9": sample("Unknown", "none", ("https://x/none-99.html", "", None), (land, "Land", "5")),
        },
        "test": {"3": sample("Land use permit", "needs a permit", (land, "Land", "5"), (labour, "Labour", "1"))},
    }
    (base / "qa").mkdir()
    for split, value in qa.items():
        (base / "qa" / f"{split}_multihop.json").write_text(json.dumps(value, ensure_ascii=False))
    return base


@pytest.fixture(scope="module")
def made(root, spark):
    at = lambda name: str(root / name)
    main(["create-from-structured", "--input-dir", at("qa"), "--structured-dir", at("laws"), "--output", at("ir")], spark)
    main(["prepare", "--ir-dir", at("ir"), "--structured-dir", at("laws"), "--output", at("exp")], spark)
    return at


def test_samples_from_structured(made, spark):
    rows = {r["query_id"]: r for r in files.read_jsonl(spark, made("ir/samples"), stages.SAMPLES).collect()}
    assert set(rows) == {"train_1", "dev_7", "dev_8", "test_3"} and rows["dev_7"]["split"] == "dev"
    assert rows["dev_7"]["positive_doc_ids"] == ["sub+(x)/labour-law-10.json#dieu=2", "plain-30.json#document"] and rows["dev_7"]["source_context_count"] == 3
    dropped = spark.read.json(made("ir/dropped")).collect()
    assert [(r["source_qa_id"], r["reason"], r["missing_links"], r["split"]) for r in dropped] == [("9", "missing_structured_context", ["https://x/none-99.html"], "dev")]
    corpus = {(r["split"], r["doc_id"]): r for r in files.read_jsonl(spark, made("ir/corpus"), stages.PASSAGES).collect()}
    assert corpus["dev", "land-law-20.json#dieu=99"]["section_type"] == "document"  # an article that is not there
    assert corpus["train", "sub+(x)/labour-law-10.json#dieu=1"]["text"].startswith("Điều 1. Leave")
    assert files.read_qrels(spark, made("ir/qrels")).where("split = 'dev'").count() == 4


def test_prepared_corpus_and_tracks(made, spark):
    corpus = {r["doc_id"]: r for r in files.read_jsonl(spark, made("exp/corpus"), stages.PASSAGES).collect()}
    assert set(corpus) == {"sub+(x)/labour-law-10.json#dieu=1", "sub+(x)/labour-law-10.json#dieu=2", "land-law-20.json#dieu=5", "land-law-20.json#dieu=99", "plain-30.json#document"}
    assert corpus["plain-30.json#document"]["title"] == "Plain"
    for track, dev in (("all_matched", 2), ("true_multihop", 2)):
        queries = files.read_jsonl(spark, made(f"exp/{track}/queries"), stages.SAMPLES)
        assert queries.where("split = 'dev'").count() == dev and files.read_qrels(spark, made(f"exp/{track}/qrels")).where("split = 'dev'").count() == 4
    manifest = {(r["track"], r["split"]): json.loads(r["counts"]) for r in spark.read.json(made("exp/manifest")).collect()}
    assert manifest["true_multihop", "dev"] == {"queries": 2, "qrels": 4, "queries_with_2plus_positives": 2} and manifest["corpus", ""]["passages"] == 5


@pytest.mark.parametrize("method", stages.METHODS)
def test_retrieval_by_every_method(made, spark, method):
    args = ["retrieve", "--corpus", made("exp/corpus"), "--queries", made("exp/all_matched/queries"), "--output", made(f"rank-{method}"), "--method", method, "--split", "dev", "--top-k", "3", "--max-hops", "2"]
    main(args, spark)
    rows = {r["query_id"]: [x["doc_id"] for x in r["results"]] for r in files.read_jsonl(spark, made(f"rank-{method}/rankings"), files.RANKINGS).collect()}
    assert set(rows) == {"dev_7", "dev_8"} and all(len(v) == len(set(v)) <= 3 for v in rows.values())
    assert "sub+(x)/labour-law-10.json#dieu=2" in rows["dev_7"]


def test_rankings_are_scored_and_described(made, spark):
    for name, method in (("a", "bm25"), ("b", "dense")):
        main(["retrieve", "--corpus", made("exp/corpus"), "--queries", made("exp/all_matched/queries"), "--qrels", made("exp/all_matched/qrels"), "--output", made(f"scored/{name}"), "--method", method, "--split", "dev", "--store", made("kept"), "--track", "all_matched"], spark)
    a, b = (json.loads(spark.read.text(made(f"scored/{x}/metrics")).first()[0]) for x in "ab")
    assert a["num_queries"] == b["num_queries"] == 2 and a["recall@10"] == 1.0 and a.get("model") is None and b["model"] == "hashed_vectors"
    assert {k: a[k] for k in ("split", "track", "seed", "search_depth")} == {"split": "dev", "track": "all_matched", "seed": 42, "search_depth": 100} and a["runtime_seconds"] > 0
    assert all(a[f"{x}_fingerprint"] == b[f"{x}_fingerprint"] and len(a[f"{x}_fingerprint"]) == 64 for x in ("corpus", "queries", "qrels"))
    main(["summarize-runs", "--runs", made("scored/*/metrics"), "--track", "all_matched", "--output", made("scored-table")], spark)
    rows = spark.read.csv(made("scored-table"), sep="\t", header=True).collect()
    assert {r["method"] for r in rows} == {"bm25", "dense"} and float(rows[0]["recall@10"]) > 0
    with pytest.raises(ValueError):
        main(["summarize-runs", "--runs", made("scored/*/metrics"), "--track", "true_multihop", "--output", made("no")], spark)
    with pytest.raises(ValueError, match="only_in|qrels|train"):  # judgements of another split
        main(["retrieve", "--corpus", made("exp/corpus"), "--queries", made("exp/all_matched/queries"), "--qrels", made("exp/all_matched/qrels"), "--output", made("no"), "--method", "bm25"][:-2] + ["--split", "train", "--qrels", made("exp/all_matched/qrels/split=dev")], spark)


def test_trained_encoder_ranks(made, spark):
    data = ["--corpus", made("exp/corpus"), "--queries", made("exp/all_matched/queries"), "--split", "dev"]
    main(["train-dense", *data, "--output", made("trained"), "--epochs", "2", "--method", "mopo"], spark)
    main(["retrieve", *data, "--output", made("rank-trained"), "--method", "dense", "--model", made("trained/model"), "--top-k", "3"], spark)
    assert files.read_jsonl(spark, made("rank-trained/rankings"), files.RANKINGS).where("size(results) = 3").count() == 2
    assert json.loads(spark.read.text(made("rank-trained/metrics")).first()[0])["model"].startswith("linear-")


def test_arguments_are_checked(made, spark):
    for args in (["retrieve", "--corpus", "c", "--queries", "q", "--output", "o", "--top-k", "0"], ["retrieve", "--corpus", "c", "--queries", "q", "--output", "o", "--top-k", "9", "--search-depth", "3"],
                 ["evaluate-qa", "--rankings", "r", "--queries", "q", "--corpus", "c", "--qa-dir", "d", "--output", "o", "--max-source-length", "255"], ["filter-multihop", "--input", "i", "--output", "o", "--min-contexts", "0"],
                 ["prepare-extractive", "--qa-dir", "q", "--ir-dir", "i", "--structured-dir", "s", "--output", "o", "--max-passages", "1"], ["run", "--qa-dir", "q", "--structured-dir", "s", "--output", "o", "--splits", "test"]):
        with pytest.raises(SystemExit):
            main(args, spark)


def test_experiment_redoes_what_depends_on_a_change(root, spark, tmp_path):
    for name in ("qa", "laws"):
        shutil.copytree(root / name, tmp_path / name)
    args = ["--qa-dir", str(tmp_path / "qa"), "--structured-dir", str(tmp_path / "laws"), "--output", str(tmp_path / "out")]

    def steps(qa_top_k=2, methods=("bm25", "dense")):
        made_ = experiments.retrieval_experiment(args[1], args[3], args[5], methods, (1,), ("dev",), "all_matched", 3, 10, 2, qa_top_k=qa_top_k)
        return {n for n, what in experiments.run_steps(spark, made_).items() if what == "done"}, {s.name for s in made_}

    done, every = steps(methods=("bm25",))
    assert done == every and len(every) == 6
    assert steps(methods=("bm25",))[0] == set()
    table = spark.read.csv(f"{args[5]}/comparison/table", sep="\t", header=True)
    assert [r["method"] for r in table.collect()] == ["bm25"] and "recall@10" in table.columns
    assert steps(qa_top_k=1, methods=("bm25",))[0] == {n for n in every if n.startswith("read ")} | {"compare readers"}  # a reader's setting
    shutil.rmtree(tmp_path / "out/runs/all_matched_bm25_seed1_dev-read/_step")  # it stopped before its end
    assert steps(qa_top_k=1)[0] == {"read all_matched_bm25_seed1_dev", "retrieve all_matched_dense_seed1_dev", "read all_matched_dense_seed1_dev", "compare", "compare readers"}
    path = tmp_path / "laws" / "land-law-20.json"
    path.write_text(path.read_text().replace("needs a permit", "needs one permit"))
    assert steps(qa_top_k=1, methods=("bm25",))[0] == every
    with pytest.raises(ValueError, match="needs"):
        experiments.run_steps(spark, [experiments.Step("x", str(tmp_path / "x"), lambda s: None, ("y",))])


def test_prompts_keep_to_the_budget(spark):
    rows = spark.createDataFrame([("q", "what", "a", [("d1", "t", "one two  three\nfour five"), ("d2", "t", "one\n two")])], "query_id string, question string, answer string, contexts array<struct<doc_id:string,title:string,text:string>>")
    seen = []

    def reader(prompts):
        seen.append(prompts.first()["source"])
        return prompts.select("query_id", F.lit("x").alias("prediction"))

    readers.predict(rows, "msg", reader, 2, answers.passage_budget(2, 260, 3)).collect()
    assert answers.passage_budget(2, 260, 3) == 1 and answers.passage_budget(10) == 147
    readers.predict(rows, "msg", reader, 2, 3).collect()
    assert "t\none\n" in seen[0] + "\n" and "one two three" in seen[1] and "four" not in seen[1] and "one\n two" in seen[1]


def test_test_split_needs_final(made, spark):
    args = ["retrieve", "--corpus", made("exp/corpus"), "--queries", made("exp/all_matched/queries"), "--output", made("rank-test"), "--split", "test"]
    with pytest.raises(SystemExit, match="--final"):
        main(args, spark)
    main([*args, "--final"], spark)
    assert files.read_jsonl(spark, made("rank-test/rankings"), files.RANKINGS).count() == 1


def test_abstractive_stage(made, spark):
    main(["prepare-abstractive", "--qa-dir", made("qa"), "--ir-dir", made("ir"), "--output", made("abs"), "--distractors", "2"], spark)
    rows = {r["query_id"]: r for r in spark.read.json(made("abs/all_matched")).collect()}
    assert rows["dev_8"]["source_qa_id"] == "8" and rows["dev_8"]["answer"] == "a permit" and rows["dev_8"]["source_context_count"] == 2
    assert rows["dev_8"]["candidate_doc_ids"][:2] == rows["dev_8"]["positive_doc_ids"] and len(rows["dev_8"]["candidate_doc_ids"]) == 4
    assert [c["hop_index"] for c in rows["dev_8"]["contexts"]] == [0, 1]
    assert json.loads(spark.read.text(made("abs/manifest")).where("value like '%dev%'").first()[0]) == {"split": "dev", "all_matched": 2, "true_multihop": 2}


def test_extractive_stage_and_evaluation(made, spark, tmp_path):
    main(["prepare-extractive", "--qa-dir", made("qa"), "--ir-dir", made("ir"), "--structured-dir", made("laws"), "--output", made("ext"), "--distractors", "1"], spark)
    rows = {r["query_id"]: r for r in spark.read.json(made("ext/all_matched")).collect()}
    for r in rows.values():
        assert r["label_method"] == "exact" and " ".join(r["flat_tokens"][r["start_position"] : r["end_position"] + 1]).replace(" .", ".") == r["answer"]
    assert rows["dev_8"]["passages"][0]["doc_id"] == "land-law-20.json#dieu=99"
    logits = [{"id": q, "passage": 0, "position": i, "start_logit": float(i == r["start_position"]), "end_logit": float(i == r["end_position"])} for q, r in rows.items() for i in range(len(r["flat_tokens"]))]
    (tmp_path / "logits.jsonl").write_text("\n".join(map(json.dumps, logits)))
    main(["evaluate-extractive", "--logits", str(tmp_path / "logits.jsonl"), "--examples", made("ext/all_matched"), "--split", "dev", "--output", str(tmp_path / "scores")], spark)
    means = json.loads(spark.read.text(str(tmp_path / "scores/metrics")).first()[0])
    assert means["num_examples"] == 2 and means["rouge_l"] == 1.0


def test_reader_evaluation_and_summary(made, spark, tmp_path):
    main(["retrieve", "--corpus", made("exp/corpus"), "--queries", made("exp/all_matched/queries"), "--output", made("ranked"), "--split", "dev"], spark)
    args = ["evaluate-qa", "--rankings", made("ranked/rankings"), "--queries", made("exp/all_matched/queries"), "--corpus", made("exp/corpus"), "--qa-dir", made("qa"), "--split", "dev", "--top-k", "2"]
    main([*args, "--output", made("read")], spark)
    predictions = {r["query_id"]: r for r in spark.read.json(made("read/predictions")).collect()}
    assert predictions["dev_7"]["reference"] == "Wages are paid monthly." and "Wages are paid monthly." in predictions["dev_7"]["prediction"]
    main(["summarize-qa", "--runs", made("read/metrics"), "--top-k", "2", "--output", str(tmp_path / "table")], spark)
    row = spark.read.csv(str(tmp_path / "table"), sep="\t", header=True).first()
    assert row["split"] == "dev" and int(row["num_examples"]) == 2
    with pytest.raises(ValueError):
        main(["summarize-qa", "--runs", made("read/metrics"), "--top-k", "9", "--output", str(tmp_path / "no")], spark)
    lacking = files.read_jsonl(spark, made("ranked/rankings"), files.RANKINGS).where("query_id <> 'dev_7'")
    q = spark.createDataFrame([("dev_7", "x")], "query_id string, text string")
    with pytest.raises(ValueError, match="without ranking"):
        stages.evaluate_reader(q, lacking, files.read_jsonl(spark, made("exp/corpus"), stages.PASSAGES), q.withColumn("answer", F.lit("a")))


def test_downstream_joins_are_strict(spark):
    q = spark.createDataFrame([("q", "x")], "query_id string, text string")
    ranked = spark.createDataFrame([("q", "d1", 1), ("q", "gone", 2)], "query_id string, doc_id string, rank long")
    docs = spark.createDataFrame([("d1", "t", "text")], "doc_id string, title string, text string")
    good = spark.createDataFrame([("q", "a")], "query_id string, answer string")
    assert answers.downstream_examples(q, ranked, docs, good, 1).first()["contexts"][0]["doc_id"] == "d1"
    with pytest.raises(Exception, match="document missing from the corpus: gone"):
        answers.downstream_examples(q, ranked, docs, good, 2).collect()
    with pytest.raises(Exception, match="no answer for query q"):
        answers.downstream_examples(q, ranked, docs, good.where("false"), 1).collect()


def test_span_model_summary_checks_runs(spark, tmp_path):
    def run(name, seed, lr, value, complete=True):
        folder = tmp_path / "runs" / name
        folder.mkdir(parents=True)
        (folder / "run_args.json").write_text(json.dumps({"method": "m", "seed": seed, "learning_rate": lr, "trainable_parameters": seed}))
        (folder / "dev_metrics.json").write_text(json.dumps({"method": "m", "num_examples": 4, "data": "d", "metrics": {"rouge_l": value}}))
        if complete:
            (folder / "COMPLETE").write_text("")

    run("a", 1, 0.1, 0.5)
    run("b", 2, 0.1, 0.7)
    args = ["summarize-extractive", "--runs", str(tmp_path / "runs"), "--output", str(tmp_path / "out")]
    main(args, spark)
    row = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).first()
    assert (row["split"], float(row["mean"]), int(row["n"])) == ("dev", pytest.approx(0.6), 2)
    run("c", 3, 0.1, 0.7, complete=False)
    with pytest.raises(ValueError, match="not complete"):
        main(args, spark)
    (tmp_path / "runs" / "c" / "COMPLETE").write_text("")
    (tmp_path / "runs" / "c" / "run_args.json").write_text(json.dumps({"method": "m", "seed": 3, "learning_rate": 0.2, "trainable_parameters": 3}))
    with pytest.raises(ValueError, match="learning_rate"):
        main(args, spark)


def test_samples_from_context_files(root, spark, tmp_path):
    (tmp_path / "contexts").mkdir()
    (tmp_path / "contexts" / "c0.json").write_text(json.dumps({"passage": "zero", "name": "Zero", "link": "l0"}))
    (tmp_path / "contexts" / "c1.json").write_text(json.dumps({"passage": "one"}))
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "dev_multihop.json").write_text(json.dumps({"5": sample("q", "a", ("u0", "D0", None), ("u1", "D1", "3"))}))
    args = ["create-samples", "--input-dir", str(tmp_path / "qa"), "--contexts-dir", str(tmp_path / "contexts"), "--output", str(tmp_path / "out")]
    main(args, spark)
    rows = {r["doc_id"]: r for r in files.read_jsonl(spark, str(tmp_path / "out/corpus"), stages.PASSAGES).collect()}
    assert (rows["c0.json"]["text"], rows["c0.json"]["title"], rows["c0.json"]["url"]) == ("zero", "Zero", "l0")
    assert (rows["c1.json"]["text"], rows["c1.json"]["title"], rows["c1.json"]["url"]) == ("one", "D1", "u1")
    assert files.read_jsonl(spark, str(tmp_path / "out/samples"), stages.SAMPLES).first()["positive_doc_ids"] == ["c0.json", "c1.json"]
    (tmp_path / "contexts" / "c1.json").unlink()
    with pytest.raises(Exception, match="context file missing: c1.json"):
        main([*args[:-1], str(tmp_path / "again")], spark)
