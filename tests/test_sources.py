"""Files: round trips and strictness."""

import hashlib
import json
import re
import shutil

import pytest
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.operators import audit, corpus, lexical
from trailmark.sources import files
from trailmark.sources.lexical_store import open_index


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("đ", 1), (None, 2)], "a string, b int")
    files.write_jsonl(rows, str(tmp_path / "x"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "x"), rows.schema).collect(), key=str) == sorted(rows.collect(), key=str)
    (tmp_path / "bad.jsonl").write_text('{"a": "x", "b": 1}\n\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), rows.schema).collect()


def test_qrels(spark, tmp_path):
    qrels = spark.createDataFrame([("q2", "d", 0), ("q1", "d", 1)], "query_id string, doc_id string, gain int")
    files.write_qrels(qrels, str(tmp_path / "q"))
    assert sorted(files.read_qrels(spark, str(tmp_path / "q")).collect()) == sorted(qrels.collect())


def test_the_last_of_repeated_judgements_counts(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("q\t0\td\t2\nq\t0\te\t1\nq\t0\td\t0\n")
    assert {r["doc_id"]: r["gain"] for r in files.read_qrels(spark, str(tmp_path / "q.tsv")).collect()} == {"d": 0, "e": 1}


def test_ids_of_contexts_without_content(spark):
    rows = spark.createDataFrame([(" x ", {"b": "1"}), ("", {"b": 'say "1"', "a": None}), (None, {"a": None, "b": 'say "1"'})], "content string, context map<string,string>")
    ids = [r[0] for r in rows.select(T.synthetic_id(F.col("content"), F.col("context"))).collect()]
    whole = json.dumps({"a": None, "b": 'say "1"'}, sort_keys=True)
    assert ids == ["x", "context_" + hashlib.sha1(whole.encode()).hexdigest()[:16], ids[1]]


def test_object_file(spark, tmp_path):
    (tmp_path / "qa.json").write_text(json.dumps({"s1": {"question": "q", "answer": "a", "contexts": {"c": {"content": "x", "link": "l", "document": "d", "điều": "5"}}}}))
    row = files.read_object_file(spark, str(tmp_path / "qa.json")).select("key", "value.question", F.col("value.contexts")["c"]["điều"].alias("n")).first()
    assert tuple(row) == ("s1", "q", "5")


def test_structured_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "law-1.json").write_text(json.dumps({"Header": "H", "Điều": [{"number": 1, "title": "One"}, "plain"]}))
    (tmp_path / "odd.json").write_text(json.dumps({"x": 1}))
    kept, rejected = files.structured_documents(files.read_tree(spark, str(tmp_path)), corpus.STRUCTURE_KINDS)
    row = kept.select("path", "stem", corpus.flatten_document(F.col("header"), F.col("sections")).alias("text")).first()
    assert tuple(row) == ("sub/law-1.json", "law-1", "H\n\nĐiều 1. One\n\nĐiều\nplain")
    assert rejected.count() == 1


def test_rankings_nest(spark):
    rows = spark.createDataFrame([("q", 2, "b", 0.5), ("q", 1, "a", 1.0)], "query_id string, rank long, doc_id string, score double")
    nested = files.nest_rankings(rows)
    assert [r["doc_id"] for r in nested.first()["results"]] == ["a", "b"]
    assert sorted(files.flatten_rankings(nested).select(*rows.columns).collect()) == sorted(rows.collect())


def test_vector_store_resumes(spark, tmp_path):
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.select("doc_id", F.array(F.length("text").cast("float")).alias("embedding"))

    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")
    key = files.config_key(model="m", length=256)
    assert files.ensure_vectors(spark, docs.where("doc_id = 1"), encode, str(tmp_path), key).count() == 1
    assert files.ensure_vectors(spark, docs, encode, str(tmp_path), key).count() == 2
    files.ensure_vectors(spark, docs, encode, str(tmp_path), key)
    assert seen == [1, 1]


def test_vector_store_is_of_its_corpus(spark, tmp_path):
    def encode(df):
        return df.where("text <> ''").select("doc_id", F.array(F.lit(1.0)).alias("embedding"))

    docs = spark.createDataFrame([(1, "a"), (2, "")], "doc_id long, text string")
    assert files.ensure_vectors(spark, docs, encode, str(tmp_path), "k").count() == 1
    seen = []
    files.ensure_vectors(spark, docs, lambda df: seen.append(1), str(tmp_path), "k")  # an id without a vector isn't tried again
    assert not seen
    with pytest.raises(ValueError, match="not of this corpus"):
        files.ensure_vectors(spark, docs.where("doc_id = 1"), encode, str(tmp_path), "k")


def test_file_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x\x00y")
    row = audit.file_digests(spark, str(tmp_path)).first()
    assert (row["bytes"], row["sha256"]) == (3, hashlib.sha256(b"x\x00y").hexdigest())


def words(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string, text string")


def ranks(index, spark):
    asked = spark.createDataFrame([("q1", "alpha người luật"), ("q2", "beta w3 w7"), ("q3", "gamma")], "query_id string, text string")
    return sorted(tuple(r) for r in lexical.bm25(asked, index, max_terms=None).select("query_id", "doc_id", "score", "rank").collect())


def corpus_rows(n, skip=(), changed=()):
    return [(f"d{i}", f"t{i % 3}" if i % 4 else None, "" if i == 5 else f"alpha w{i % 9} beta" + (" gamma luật" if i in changed or i % 6 == 0 else "")) for i in range(n) if i not in skip]


def test_stored_index_ranks_as_one_built_at_once(spark, tmp_path):
    root = str(tmp_path / "index")
    first = open_index(words(spark, corpus_rows(20)), root)
    assert ranks(first, spark) == ranks(lexical.build_index(words(spark, corpus_rows(20))), spark)
    steps = [corpus_rows(30), corpus_rows(40, changed=(1, 2, 31)), corpus_rows(40, skip=(3, 6, 32), changed=(1, 31)), corpus_rows(41, skip=(6,), changed=(1, 31, 40))]
    for i, rows in enumerate(steps):
        now = words(spark, rows).repartition(3)
        index = open_index(now, root)
        built = lexical.build_index(now)
        assert ranks(index, spark) == ranks(built, spark), i
        assert sorted(map(str, index.vocabulary.select("term", "df").collect())) == sorted(map(str, built.vocabulary.select("term", "df").collect()))
        assert index.statistics().first() == built.statistics().first()
        state = json.loads(spark.read.text(f"{root}/v{i + 1}/state").first()[0])
        assert state["runs"] == list(range(i + 2)) and state["dead"] == (i > 0)
    assert spark.read.parquet(f"{root}/v1/postings").select("doc_id").distinct().count() == 10  # a run holds new passages only


def test_stored_index_is_reused_and_compacted(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = words(spark, corpus_rows(12))
    open_index(docs, root)
    open_index(docs.orderBy(F.desc("doc_id")), root)
    assert len(files.names(spark, f"{root}/v*")) == 1  # same content in another order
    for n in (13, 14, 15):
        index = open_index(words(spark, corpus_rows(n)), root, most_runs=3)
    state = json.loads(spark.read.text(f"{root}/v3/state").first()[0])
    assert state["runs"] == [3] and ranks(index, spark) == ranks(lexical.build_index(words(spark, corpus_rows(15))), spark)
    other = open_index(words(spark, [(f"x{i}", "", "gamma") for i in range(15)]), root)  # nothing of the old is left
    assert json.loads(spark.read.text(f"{root}/v4/state").first()[0])["runs"] in ([3, 4], [4]) and len(ranks(other, spark)) == 10
    shutil.rmtree(f"{root}/v4/state")  # a version without its state never ended
    assert ranks(open_index(words(spark, corpus_rows(15)), root), spark) == ranks(index, spark)


def test_stored_index_keeps_its_fold(spark, tmp_path):
    docs = words(spark, [("d1", "", "Người lao động"), ("d2", "", "đất"), ("d3", "", "khác")])
    plain, folded = (open_index(docs, str(tmp_path / f), f) for f in ("none", "full"))
    again = open_index(docs, str(tmp_path / "full"), "full")
    asked = spark.createDataFrame([("q", "nguoi")], "query_id string, text string")
    assert [lexical.bm25(asked, x).count() for x in (plain, folded, again)] == [0, 1, 1]
    assert open_index(docs, str(tmp_path / "full"), "none").fold == "none"  # other settings, another version


def test_a_search_opens_only_its_terms_partitions(spark, tmp_path):
    docs = words(spark, [(f"d{i}", "", " ".join(f"w{i}x{j}" for j in range(20))) for i in range(50)])
    index = open_index(docs, str(tmp_path / "i"), buckets=32)
    asked = spark.createDataFrame([("q", "w3x4")], "query_id string, text string")
    near = index.near(asked.select(F.col("text").alias("term")))
    assert near.words().select("bucket").distinct().count() == 1
    assert near.words().select(F.input_file_name()).distinct().count() < index.words().select(F.input_file_name()).distinct().count()
    plan = lexical.bm25(asked, index)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(", plan)


def test_empty_corpus_has_an_index(spark, tmp_path):
    empty = words(spark, [])
    assert ranks(open_index(empty, str(tmp_path / "i")), spark) == []
    assert len(ranks(open_index(words(spark, corpus_rows(8)), str(tmp_path / "i")), spark)) > 0


def test_manifest_and_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "a int, b string")
    files.write_manifest(rows, str(tmp_path / "m"))
    files.write_comparison(rows, ["b"], str(tmp_path / "t"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"a": 1, "b": "x"}
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first()["b"] == "x"
