"""Retrieval, fusion, hops, metrics and audits on small literal cases."""

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import vectors as V
from trailmark.operators import audit, dense, docids, evaluation, lexical, multihop
from trailmark.plans.queries import QUERIES


def ranking(spark, rows):
    return spark.createDataFrame([(q, i + 1, d) for q, docs in rows.items() for i, d in enumerate(docs)], "query_id string, rank long, doc_id string")


def test_metrics_capture_all_evidence(spark):
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 1), ("q2", "c", 1)], "query_id string, doc_id string, gain int")
    rows = evaluation.ranking_metrics(qrels, ranking(spark, {"q1": ["x", "a", "b"], "q2": ["c"]}), (1, 2, 3)).collect()
    by = {r["k"]: r for r in rows}
    assert by[1]["recall"] == 0.5 and by[2]["recall"] == 0.75
    assert by[3]["complete_evidence"] == 1.0 and by[3]["mrr"] == 0.75
    assert all(r["num_queries"] == 2 for r in rows)


def test_metrics_edge_cases(spark):
    qrels = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 0), ("q2", "c", 1)], "query_id string, doc_id string, gain int")
    rows = {r["query_id"]: r for r in evaluation.per_query_metrics(qrels, ranking(spark, {"q1": ["b", "b", "a"]}), (2,)).collect()}
    assert rows["q1"]["recall"] == 1.0 and rows["q1"]["map"] == 0.5  # repeats count once, before the cut
    assert rows["q1"]["ndcg"] == pytest.approx((3 / math.log2(3)) / 3)
    assert rows["q2"]["recall"] == rows["q2"]["ndcg"] == 0.0  # no ranking
    assert evaluation.ranking_metrics(qrels.where("false"), ranking(spark, {"q": ["a"]})).count() == 0


def test_validation(spark):
    queries = spark.createDataFrame([("q1",)], "query_id string")
    corpus = spark.createDataFrame([("d1",)], "doc_id string")
    good = spark.createDataFrame([("q1", "d1", 1)], "query_id string, doc_id string, gain int")
    bad = spark.createDataFrame([("q1", "missing", 1), ("q2", "d1", 0)], "query_id string, doc_id string, gain int")
    audit.require(audit.validate(queries, good, corpus))
    with pytest.raises(ValueError, match="missing"):
        audit.require(audit.validate(queries, bad, corpus))
    assert {r["problem"] for r in audit.validate(queries, bad, corpus).collect()} == {"document not in corpus", "judgements without query", "query without relevant document"}
    assert audit.same_queries(good, bad).count() == 1


def test_fusion(spark):
    fused = dense.rrf_fuse(ranking(spark, {"q": ["a", "b"]}), ranking(spark, {"q": ["b", "c"]}), constant=10).orderBy("rank").collect()
    assert [r["doc_id"] for r in fused] == ["b", "a", "c"]
    again = dense.rrf_fuse(ranking(spark, {"q": ["b", "c"]}), ranking(spark, {"q": ["a", "b"]}), constant=10).orderBy("rank").collect()
    assert fused == again


def test_dense_search_is_exact(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "doc_id long, v array<double>")
    query = spark.createDataFrame([(9, [0.9, 0.1])], "query_id long, v array<double>")
    assert [r["doc_id"] for r in dense.dense_search(query, docs, 2).orderBy("rank").collect()] == [1, 2]


def passages(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def test_bm25_scores(spark):
    index = lexical.build_index(passages(spark, [(1, "", "luật lao động nghỉ phép năm"), (2, "", "luật đất đai quyền sử dụng đất"), (3, "", ""), (4, None, "hợp đồng")]))
    query = spark.createDataFrame([(1, "nghỉ phép lao động"), (2, "là và"), (3, "vắng mặt"), (4, "")], "query_id long, text string")
    rows = lexical.bm25(query, index).orderBy("query_id", "rank").collect()
    assert rows[0]["doc_id"] == 1 and len(rows) == 1
    n, length, mean = 4, 6, (6 + 7 + 0 + 2) / 4
    one = math.log((n - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))
    assert rows[0]["score"] == pytest.approx(4 * one, abs=1e-6)


def test_bm25_prunes_to_rare_terms_and_weights_titles(spark):
    index = lexical.build_index(passages(spark, [(1, "alpha", "beta"), (2, "beta", "alpha"), (3, "", "alpha beta gamma"), (4, "", "delta"), (5, "", "delta"), *[(i, "", "echo") for i in range(6, 12)]]))
    query = spark.createDataFrame([(1, "alpha gamma"), (2, "delta")], "query_id long, text string")
    rare = lexical.bm25(query, index, max_terms=1).collect()
    assert {(r["query_id"], r["doc_id"]) for r in rare} == {(1, 3), (2, 4), (2, 5)}
    full = {r["doc_id"]: r["score"] for r in lexical.bm25(query.where("query_id = 1"), index, max_terms=None).collect()}
    assert full[1] > full[2]


def test_negatives_leave_positives_out(spark):
    p = passages(spark, [(1, "a", "one two"), (2, "b", "one three"), (3, "c", "four")])
    query = spark.createDataFrame([(1, "one two")], "query_id long, text string")
    positive = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    assert [r["doc_id"] for r in lexical.okapi_negatives(query, p, positive).collect()] == [2]
    over = lexical.overlap_negatives(query, lexical.build_index(p), positive)
    assert [(r["doc_id"], r["score"]) for r in over.collect()] == [(2, 1.0)]
    filled = lexical.backfill(over, query, p, positive, 2, seed=1).orderBy("rank").collect()
    assert [r["doc_id"] for r in filled] == [2, 3]


def test_trie(spark):
    ids = spark.createDataFrame([("doc-a", [2, 3]), ("doc-b", [2, 4]), ("empty", [])], "doc_id string, tokens array<int>")
    states = spark.createDataFrame([("root", []), ("mid", [2]), ("leaf", [2, 3]), ("again", [2, 3, 9]), ("off", [5])], "state_id string, generated array<int>")
    got = {r["state_id"]: set(r["allowed"]) for r in docids.allowed_next(docids.prefix_table(ids), states, separator=9, end=1).collect()}
    assert got == {"root": {2}, "mid": {3, 4}, "leaf": {1, 9}, "again": {2}, "off": {1}}


def plain_decode(tokens, score, separator, end, beams, steps):
    """Token by token, with forced tokens written at once."""
    ids = {tuple(t) for t in tokens if t}

    def allowed(part):
        out = sorted({t[len(part)] for t in ids if len(t) > len(part) and t[: len(part)] == part})
        return out + ([separator, end] if part in ids else []) or [end]

    def part_of(generated):
        at = len(generated) - generated[::-1].index(separator) if separator in generated else 0
        return tuple(generated[at:])

    held = [(0.0, [], False)]
    for _ in range(steps):
        out = [h for h in held if h[2]]
        for total, generated, done in held:
            if done:
                continue
            options = allowed(part_of(generated))
            for token in options:
                now = generated + [token]
                while token not in (separator, end) and len(more := allowed(part_of(now))) == 1 and more[0] != end:
                    now = now + more
                out.append((total + (score(generated, token) if len(options) > 1 else 0.0), now, token == end))
        held = sorted(out, key=lambda h: (-h[0], h[1]))[:beams]
    return [(i + 1, h[1], h[0]) for i, h in enumerate(held)]


@pytest.mark.parametrize("beams, steps", [(1, 6), (3, 4)])
def test_decoding_matches_a_plain_one(spark, beams, steps):
    tokens = [[2, 3], [2, 4], [2, 4, 5, 6, 7], [8], [8, 3, 3], []]
    ids = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(tokens)], "doc_id string, tokens array<int>")
    value = lambda q: lambda generated, token: -float((7 * q + 3 * len(generated) + token * token) % 11)

    def score(options):
        return options.withColumn("gain", -((7 * F.col("query_id") + 3 * F.size("generated") + F.col("token") * F.col("token")) % 11).cast("double"))

    asked = spark.createDataFrame([(q, "x") for q in range(5)], "query_id int, text string")
    got = {}
    for r in docids.decode(asked, docids.trie_edges(ids), score, 1, 0, beams, steps).orderBy("query_id", "beam").collect():
        got.setdefault(r["query_id"], []).append((r["beam"], r["generated"], r["total"]))
    assert got == {q: plain_decode(tokens, value(q), 1, 0, beams, steps) for q in range(5)}


def test_trie_has_no_forced_steps(spark):
    ids = spark.createDataFrame([("a", [2, 3, 4]), ("b", [2, 3, 5]), ("c", [2, 3])], "doc_id string, tokens array<int>")
    got = {(tuple(r["prefix"]), tuple(r["run"]), r["options"]) for r in docids.trie_edges(ids).collect()}
    assert got == {((), (2, 3), 1), ((2, 3), (4,), 4), ((2, 3), (5,), 4), ((2, 3), (-1,), 4), ((2, 3, 4), (-1,), 2), ((2, 3, 5), (-1,), 2)}


def test_generated_sequences_resolve(spark):
    ids = spark.createDataFrame([("Doc A", [3, 4]), ("b", [3]), ("c", [5, 6])], "doc_id string, tokens array<int>")
    written = spark.createDataFrame([("q", [3, 4, 1, 5, 6, 1, 3, 4, 2, 3]), ("cut", [3, 1, 5]), ("none", [2])], "query_id string, generated array<int>")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in docids.resolve_ids(docids.decoded_ids(written, ids, 1, 2), ids).collect()}
    assert got == {("q", 1): ("Doc A", 2.0), ("q", 2): ("c", 1.0), ("cut", 1): ("b", 1.0)}


def test_spelling_out_a_ranking(spark):
    docs = spark.createDataFrame([("x/é",), ("x/a",), ("x/ab",), ("y",)], "doc_id string")
    ids = docs.select("doc_id", docids.byte_tokens("doc_id").alias("tokens"))
    assert ids.where("doc_id = 'x/é'").first()["tokens"] == [b + 3 for b in "x/é".encode()]
    hits = spark.createDataFrame([("q", "x/ab", 1), ("q", "x/é", 2), ("q", "x/a", 3), ("p", "y", 1)], "query_id string, doc_id string, rank long")
    asked = spark.createDataFrame([("q", ""), ("p", ""), ("none", "")], "query_id string, text string")
    best = docids.decode(asked, docids.trie_edges(ids), docids.spelled(hits, ids, 1, 2), 1, 2)
    got = {}
    for r in docids.resolve_ids(docids.decoded_ids(best, ids, 1, 2), ids).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got["q"] == ["x/ab", "x/é", "x/a"] and got["p"] == ["y"] and len(got["none"]) == 1


def test_maxsim(spark):
    rows = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 0.0]]), ([[1.0, 0.0], [0.0, 1.0]], [[0.0, 1.0], [0.0, 1.0]])], "q array<array<double>>, d array<array<double>>")
    scores = [r[0] for r in rows.select(V.focused_maxsim(F.col("q"), F.col("d"))).collect()]
    assert scores[0] == scores[1] == pytest.approx(1.0)


def test_mean_pool(spark):
    row = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert row.select(V.pooled_mean(F.col("t"), F.col("m"))).first()[0] == pytest.approx([0.6, 0.8])


def test_concise_fact(spark):
    rows = spark.createDataFrame([("One two. Three four!  Five six\nseven two", "two four"), ("", "x"), (None, "x")], "t string, q string")
    got = [r[0] for r in rows.select(T.concise_fact(F.col("t"), F.col("q"))).collect()]
    assert got == ["One two. Three four!", "", ""]


def test_hops_carry_evidence(spark):
    p = passages(spark, [(1, "", "alpha bravo."), (2, "", "bravo charlie."), (3, "", "charlie delta.")])
    index = lexical.build_index(p)
    queries = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    lists = multihop.greedy_hops(queries, lambda q: lexical.bm25(q, index, max_terms=None), p)
    assert [[r["doc_id"] for r in x.orderBy("rank").collect()] for x in lists][0] == [1]
    assert {r["doc_id"] for r in lists[2].collect()} >= {1, 2, 3}
    assert multihop.fuse_hops(lists, "m3").count() == 3


def test_text_functions(spark):
    rows = spark.createDataFrame([("Nghị định số 45/2019 đất", "https://x.vn/a/Luat-Dat-Dai-123.html?x=1")], "t string, u string")
    r = rows.select(T.slug(F.col("t")).alias("s"), T.url_stem(F.col("u")).alias("u"), T.trailing_id(T.url_stem(F.col("u"))).alias("n"), T.detokenize(T.word_mark_tokens(F.lit("a, (b) c."))).alias("d")).first()
    assert (r["s"], r["u"], r["n"], r["d"]) == ("nghiinhso452019at", "Luat-Dat-Dai-123", "123", "a, (b) c.")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_meteor_bounds(a, b):
    score = evaluation.meteor_one(" ".join(a), " ".join(b))
    assert 0.0 <= score <= 1.0 and (score == 1.0) >= (a == b)


def test_rouge_forms_agree(spark):
    rows = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("a", ""), ("The  Cat", "the cat"), (None, "x")], "p string, r string")
    got = rows.select(evaluation.rouge_l(F.col("p"), F.col("r")).alias("a"), evaluation.rouge_l_long(F.col("p"), F.col("r")).alias("b")).collect()
    assert [r["a"] for r in got] == pytest.approx([4 / 7, 1, 0, 1, 0])
    assert [r["b"] for r in got] == pytest.approx([4 / 7, 1, 0, 1, 0])


def test_fingerprints_count_repetitions(spark):
    def of(rows):
        return audit.table_fingerprint(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()["digest"]

    one, two = [("1", "1"), ("1", "1"), ("5", "5")], [("2", "2"), ("2", "2"), ("5", "5")]
    assert of(one) != of(two) and of(one) == of(one[::-1]) and of(one) != of(one[1:])
    assert len({of([("a\x1fb", "c")]), of([("a", "b\x1fc")]), of([(None, "c")]), of([("∅", "c")]), of([("", "c")]), of([("-", "c")]), of([])}) == 7


def test_seed_summary(spark):
    runs = spark.createDataFrame([("m", 1, "x", 1.0), ("m", 2, "x", 3.0), ("m", 1, "y", 1.0), ("n", 1, "x", 2.0)], "method string, seed int, metric string, value double")
    got = {(r["method"], r["metric"]): (r["mean"], r["std"]) for r in audit.summarize_seeds(runs).collect()}
    assert got == {("m", "x"): (2.0, pytest.approx(math.sqrt(2))), ("n", "x"): (2.0, None)}
    assert audit.varying_columns(runs, ["metric"], ["method"]).count() == 1
    assert audit.unexpected(runs, {"method": "m"}).count() == 1
    assert audit.table_fingerprint(runs, runs.columns).first() == audit.table_fingerprint(runs.orderBy(F.desc("value")), runs.columns).first()


def test_dense_search_takes_any_ids(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("aa", [1.0, 0.0])], "doc_id string, v array<double>").repartition(3)
    asked = spark.createDataFrame([("q", [0.9, 0.1]), ("a", [0.0, 1.0])], "query_id string, v array<double>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in dense.dense_search(asked, docs, 2).collect()}
    assert got == {("q", 1): "a", ("q", 2): "aa", ("a", 1): "b", ("a", 2): "a"}  # ties to the smaller id
    assert {r["doc_id"] for r in dense.dense_search(asked.where("query_id = 'a'"), docs, 2, same_ids=True).collect()} == {"b", "aa"}
    tiles = {(r["query_id"], r["rank"]): r["doc_id"] for r in dense.dense_search(asked, docs, 2, tile_bytes=16).collect()}
    assert tiles == got and dense.dense_search(asked, docs.where("false"), 2).count() == 0 and dense.dense_search(asked.where("false"), docs, 2).count() == 0


def test_dense_search_meets_in_tiles(spark):
    vectors = spark.range(3000).selectExpr("id as doc_id", "array(cast((id * 37) % 101 as double), cast(id % 7 as double)) as v")
    asked = vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    found = dense.dense_search(asked, vectors, 4, tile_bytes=2048)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = {r["doc_id"]: r["v"] for r in vectors.collect()}
    for q in (0, 1700, 2900):
        want = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items())[:4]
        assert [(-r["score"], r["doc_id"]) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_dense_search_keeps_the_best_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.range(0, 200, 1, 3).selectExpr("id as doc_id", "array(cast((id * 37) % 101 as double), 1d) as v")
        asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
        got = [r["doc_id"] for r in dense.dense_search(asked, docs, 6).orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(range(200), key=lambda i: (-((i * 37) % 101), i))[:6]


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "A b a"), (2, "b, A; a"), (3, "other words"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["v"] for r in dense.hashed_vectors(rows).collect()}
    places = [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 for w in ("a", "b", "a")]
    assert got[1] == pytest.approx([places.count(i) / math.sqrt(sum(places.count(j) ** 2 for j in set(places))) for i in range(64)])
    assert set(got) == {1, 2, 3} and got[1] == got[2] != got[3] and math.fsum(x * x for x in got[1]) == pytest.approx(1)


def test_folding(spark):
    assert [r[0] for r in spark.createDataFrame([("người đường é",)], "t string").select(F.explode(T.word_list(F.col("t"), "full"))).collect()] == ["nguoi", "đuong", "e"]
    assert spark.createDataFrame([("người é",)], "t string").select(T.word_list(F.col("t"), "single")).first()[0] == ["nguời", "e"]  # two marks stay
    docs = spark.createDataFrame([(1, "", "nguoi lao dong"), (2, "", "other")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([("q", "người lao")], "query_id string, text string")
    assert lexical.bm25(asked, lexical.build_index(docs, fold="full")).first()["doc_id"] == 1
    with pytest.raises(ValueError):
        T.folded(F.col("t"), "other")


def test_reasoning_shows_each_passage_once(spark):
    docs = spark.createDataFrame([("d1", "One", "alpha bravo."), ("d2", "Two", "bravo charlie."), ("d3", "Three", "delta echo.")], "doc_id string, title string, text string")
    asked = spark.createDataFrame([("q", "alpha"), ("none", "zulu")], "query_id string, text string")
    index, prompts = lexical.build_index(docs), []

    def reasoner(rows):
        prompts.append({r["query_id"]: r["prompt"] for r in rows.collect()})
        return rows.select("query_id", F.lit("bravo\nnot this").alias("line"))

    got = multihop.interleaved_reasoning(asked, lambda q: lexical.bm25(q, index).select("query_id", "doc_id", "score", "rank"), docs, hops=3, reasoner=reasoner)
    assert {r["doc_id"] for r in got.where("query_id = 'q'").collect()} == {"d1", "d2"}
    assert "One: alpha bravo." in prompts[0]["q"] and "Reasoning so far" not in prompts[0]["q"]
    assert "Two: bravo charlie." in prompts[1]["q"] and "One:" not in prompts[1]["q"] and "\nReasoning so far: bravo\n" in prompts[1]["q"]
    assert prompts[0]["none"].endswith("\nEvidence:\n\nNext sentence:")


def test_hops_rerank_with_their_own_queries(spark):
    docs = spark.createDataFrame([("d1", "alpha bravo."), ("d2", "bravo charlie.")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, text string")
    index, seen = lexical.build_index(docs.withColumn("title", F.lit(""))), []

    def rerank(ranked, queries):
        seen.append(queries.first()["text"])
        return ranked

    lists = multihop.greedy_hops(asked, lambda q: lexical.bm25(q, index).select("query_id", "doc_id", "score", "rank"), docs, 2, rerank=rerank)
    assert seen == ["alpha", "alpha\nEvidence so far: alpha bravo."] and len(lists) == 2


def test_compatibility_forms_count_as_one(spark):
    rows = spark.createDataFrame([("ﬁne Ａ", "fine a")], "p string, r string")
    assert rows.select(evaluation.rouge_l(F.col("p"), F.col("r")).alias("a")).first()["a"] == 1.0


def test_words_are_counted_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([["t"]] * 400), pa.array([["a", "b"] * 500] * 399 + [None])], names=["doc_id", "a", "b"])
    parts = list(lexical._counted(iter([batch])))
    assert len(parts) > 1 and all(pc.sum(p.filter(pc.equal(p["term"], ""))["length"]).as_py() <= lexical.MOST_WORDS for p in parts)
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    want = [(t, i, n, m, 1001) for i in range(399) for t, n, m in (("", 0, 1), ("t", 1, 0), ("a", 0, 500), ("b", 0, 500))] + [("", 399, 0, 1, 1), ("t", 399, 1, 0, 1)]
    assert sorted(rows) == sorted(want)


def test_queries_bound_arrow_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    QUERIES["bm25_full_index"](spark, "/root/testdata/sf0.001")
    try:
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 16 << 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def scored_cases(spark):
    docs = passages(spark, [(i, f"w{i % 7}", f"alpha w{i % 5} w{i % 11} " * (1 + i % 3)) for i in range(600)])
    asked = spark.createDataFrame([(q, f"alpha w{q} w{q + 1}") for q in range(6)], "query_id long, text string")
    positive = spark.createDataFrame([(q, 5 * q + 1) for q in range(6)], "query_id long, doc_id long")
    index = lexical.build_index(docs)
    return {
        "bm25": lambda: lexical.bm25(asked, index, max_terms=None), "okapi": lambda: lexical.okapi_negatives(asked, docs, positive), "overlap": lambda: lexical.overlap_negatives(asked, index, positive),
    }


@pytest.mark.parametrize("name", ["bm25", "okapi", "overlap"])
def test_pairs_are_scored_where_their_passages_are(spark, name, monkeypatch):
    """Pairs are never shuffled, nor postings by pair; other ways to the same give the same."""
    case = scored_cases(spark)[name]
    found = case()
    plan = plan_of(found)
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\((query_id#\d+L?, doc_id|term#\d+, doc_id)", plan) and "WindowGroupLimit" in plan
    rows = sorted(found.collect())
    monkeypatch.setattr(lexical, "PAIRS", 64)
    assert sorted(case().collect()) == rows
    monkeypatch.setattr(lexical, "FEW", 0)
    assert sorted(case().collect()) == rows


def test_tries_are_not_sent_about(spark):
    ids = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("doc_id"), docids.byte_tokens(F.concat(F.lit("d"), "id")).alias("tokens"))
    edges = docids.trie_edges(ids)
    rows = sorted((tuple(r["prefix"]), tuple(r["run"]), r["options"]) for r in edges.collect())  # the final plan
    assert rows and "BroadcastHashJoin" not in plan_of(edges)
    found = docids.resolve_ids(spark.createDataFrame([("q", 0, "D 17")], "query_id string, pos int, candidate string"), ids)
    assert [r["doc_id"] for r in found.collect()] == ["d17"] and "BroadcastHashJoin" not in plan_of(found)
