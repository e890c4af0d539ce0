"""QA examples: joins, prompts, passages, span labels, training rows."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.operators import answers as A
from trailmark.operators import corpus, evaluation


def test_downstream_examples(spark):
    queries = spark.createDataFrame([("test_1", "q?")], "query_id string, text string")
    ranked = spark.createDataFrame([("test_1", "d1", 1.0, 1)], "query_id string, doc_id string, score double, rank long")
    docs = spark.createDataFrame([("d1", "t", "x"), ("d2", "t", "y")], "doc_id string, title string, text string")
    answers = spark.createDataFrame([("test_1", "đáp án")], "query_id string, answer string")
    row = A.downstream_examples(queries, ranked, docs, answers).first()
    assert row["answer"] == "đáp án" and [c["doc_id"] for c in row["contexts"]] == ["d1"]


def test_enrichment_fails_on_missing(spark):
    docs = spark.createDataFrame([(1, "t", "x")], "doc_id long, title string, text string")
    rows = lambda ids: spark.createDataFrame([("q", ids, [1])], "query_id string, candidate_doc_ids array<long>, positive_doc_ids array<long>")
    got = A.enrich_contexts(rows([1]), docs).first()["contexts"]
    assert got[0]["is_positive"] and got[0]["hop_index"] == 0
    with pytest.raises(PySparkException):
        A.enrich_contexts(rows([1, 7]), docs).collect()


def test_prompts(spark):
    rows = spark.createDataFrame([(" why? ", [("d1", "T", " body "), ("d2", "", "more")])], "q string, c array<struct<doc_id:string,title:string,text:string>>")
    plain = rows.select(A.build_source(F.col("q"), F.col("c"), "ask_to_understand")).first()[0]
    assert plain.endswith("question: why?\n\n[PASSAGE_1] T\nbody\n\n[PASSAGE_2] d2\nmore")
    path = rows.select(A.build_source(F.col("q"), F.col("c"), "pathfid", 1)).first()[0]
    assert path.endswith("<title-1> [PASSAGE_1] T\n<context-1> body")
    with pytest.raises(ValueError):
        A.build_source(F.col("q"), F.col("c"), "none")
    assert A.passage_budget(10) == 147 and A.passage_budget(1) == 256


def test_passages_go_round(spark):
    rows = spark.createDataFrame([("q", 0, 10, "a b c d e"), ("q", 1, 11, "f g"), ("q", 2, 12, ""), ("q", 3, 13, None)], "query_id string, ctx int, doc_id long, text string")
    got = A.build_passages(rows, most=3, size=2).orderBy("global_start").collect()
    assert [(r["ctx"], r["chunk_index"], r["global_start"], r["global_end"]) for r in got] == [(0, 0, 0, 1), (1, 0, 2, 3), (0, 1, 4, 5)]


def test_exact_spans_in_order_of_preference(spark):
    rows = spark.createDataFrame(
        [("w", 0, 1, "x the exact answer here"), ("f", 0, 1, "x long part of it y"), ("s", 0, 1, "x yes , no z"), ("n", 0, 1, "x"), ("e", 0, 1, "x")], "query_id string, ctx int, doc_id long, text string"
    )
    answers = spark.createDataFrame([("w", "the exact answer"), ("f", "absent words.\nlong part of it"), ("s", "yes no"), ("n", "absent"), ("e", "")], "query_id string, answer string")
    got = {r["query_id"]: (r["start"], r["end"], r["method"]) for r in A.exact_spans(A.build_passages(rows), answers).collect()}
    assert got == {"w": (1, 3, "exact"), "f": (1, 4, "fragment"), "s": (1, 3, "subsequence")}


def brute_window(a, c):
    best = None
    n, m = len(a), len(c)
    longest = min(m, max(1, min(1536, 2 * n)))
    for w in {max(1, n // 2), max(1, n - 16), n, min(longest, n + 16), longest}:
        if w > m:
            continue
        for s in range(m - w + 1):
            o = sum((Counter(a) & Counter(c[s : s + w])).values())
            key = (-2.0 * o / (n + w), w, s)
            best = min(best, key) if best else key
    return best[2], best[2] + best[1] - 1, -best[0]


def test_overlap_window_is_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, c = ([rng.choice("abcdef") for _ in range(rng.randint(1, 30))] for _ in range(2))
        s, e, score = A.overlap_window(a, c)
        assert (s, e, pytest.approx(score)) == brute_window(a, c)
    assert A.overlap_window([], ["a"]) == (0, 0, 0.0) == A.overlap_window(["a"], [])


def test_spans_stay_inside_passages(spark):
    rows = spark.createDataFrame([("q", 0, 1, "a b c"), ("q", 1, 2, "d e f")], "query_id string, ctx int, doc_id long, text string")
    built = A.build_passages(rows, size=3)
    spans = A.overlap_spans(built, spark.createDataFrame([("q", "c d e")], "query_id string, answer string"))
    row = spans.first()
    assert (row["start"], row["end"]) == (3, 5)
    marked = A.answer_passages(built, spans.withColumnRenamed("overlap_score", "score")).orderBy("global_start").collect()
    assert [r["is_answer_passage"] for r in marked] == [False, True]


def test_span_decoding(spark):
    logits = spark.createDataFrame([(1, 0, 0, 1.0, 0.0), (1, 0, 1, 0.0, 2.0), (1, 1, 2, 5.0, -9.0), (1, 1, 3, 0.0, -9.0)], "id long, passage long, position long, start_logit double, end_logit double")
    row = evaluation.decode_spans(logits).first()
    assert (row["span_start"], row["span_end"], row["score"]) == (0, 1, 3.0)


def test_hop_rotation(spark):
    positives = spark.createDataFrame([("q", "what law", ["d1", "d2"])], "query_id string, question string, doc_ids array<string>")
    docs = spark.createDataFrame([("d1", "First law fact."), ("d2", "Second law fact.")], "doc_id string, text string")
    rows = {(e, m): A.hop_training_rows(positives, docs, e, m).first() for e in (0, 1) for m in ("dense", "mdr")}
    assert rows[0, "dense"]["positive_id"] == rows[0, "mdr"]["positive_id"] == "d1"
    assert "Evidence so far: First law fact." in rows[1, "mdr"]["query"] and rows[1, "mdr"]["positive_id"] == "d2"
    assert rows[1, "mdr"]["posterior_query"].endswith("Posterior evidence: Second law fact.")


def test_losses(spark):
    import math

    s = spark.createDataFrame([("q", "a", 0.5, True, 0.5), ("q", "b", 0.1, False, 0.1)], "query_id string, doc_id string, score double, positive boolean, teacher double")
    loss = A.contrastive_loss(s).first()["loss"]
    assert loss == pytest.approx(math.log(math.exp(10) + math.exp(2)) - 10)
    assert A.distillation_kl(s.withColumnRenamed("score", "student")).first()["kl"] == pytest.approx(0.0)


def test_references_resolve_in_three_tiers(spark):
    docs = spark.createDataFrame([(1, "luat-a-1"), (2, "luat-b-2"), (3, "nghi-dinh-c-2"), (4, "thong-tu-xyz")], "doc_id long, stem string")
    refs = spark.createDataFrame([(1, "http://x/other-1.html"), (2, "http://x/luat-b-2.aspx"), (3, "http://x/none-2"), (4, "http://x/thong-tu-xyz"), (5, "http://x/absent"), (6, None)], "ref_id long, url string")
    got = {r["ref_id"]: (r["doc_id"], r["tier"]) for r in corpus.resolve_references(refs, docs).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (None, None), 4: (4, 3), 5: (None, None), 6: (None, None)}


def test_all_or_nothing(spark):
    rows = spark.createDataFrame([("s", 0, "u", 5), ("s", 1, "v", 4), ("s", 2, "u", 5), ("t", 0, "w", None), ("t", 1, "u", 5)], "sample_id string, pos int, url string, doc_id long")
    kept, dropped = corpus.all_or_nothing(rows)
    assert kept.first()["doc_ids"] == [5, 4] and kept.count() == 1
    assert dropped.first()["missing_links"] == ["w"]


def test_corpus_records_fall_back_to_the_document(spark):
    section = "array<struct<kind:string,number:string,title:string,plain:string>>"
    docs = spark.createDataFrame(
        [("s", "p.json", "T", "u", "Head", [("Điều", "1", "One", None), ("Điều", "1", "Again", None), ("Phần", None, None, "plain")])], f"source_id string, path string, title string, url string, header string, sections {section}"
    )
    requests = spark.createDataFrame([("s", "1"), ("s", "9"), ("s", ""), ("s", None)], "source_id string, article string")
    got = {r["section_number"]: r for r in corpus.corpus_records(requests, docs).collect()}
    assert got["1"]["text"] == "Điều 1. One" and got["1"]["doc_id"] == "p.json#dieu=1" and got["1"]["section_type"] == "article"
    assert got["9"]["doc_id"] == "p.json#dieu=9" and got["9"]["section_type"] == "document"
    assert got[""]["doc_id"] == got[None]["doc_id"] == "p.json#document"
    assert got[None]["text"] == "Head\n\nPhần\nplain\n\nĐiều 1. One\n\nĐiều 1. Again"


def test_corpus_keeps_gold_first(spark):
    own = spark.createDataFrame([("a", 1, "own", ""), ("a", 0, "older", "u"), ("b", 0, "b", "v")], "doc_id string, pos int, title string, url string")
    gold = spark.createDataFrame([("a", 9, "", "")], "doc_id string, pos int, title string, url string")
    got = {r["doc_id"]: r for r in corpus.global_corpus(own, gold).collect()}
    assert got["a"]["pos"] == 9 and got["a"]["title"] == "older" and got["a"]["url"] == "u" and got["b"]["title"] == "b"


def test_training_rows_rotate_over_what_the_corpus_holds(spark):
    corpus = spark.createDataFrame([("d1", "First fact."), ("d3", "Third fact.")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "question", ["d1", "gone", "d3"]), ("none", "question", ["gone"])], "query_id string, question string, doc_ids array<string>")
    (row,) = A.hop_training_rows(asked, corpus, 1).collect()
    assert (row["positive_id"], row["hop"], row["query"]) == ("d3", 1, "question\nEvidence so far: First fact.")
    assert row["posterior_query"] == row["query"] + "\nPosterior evidence: Third fact."
    assert A.hop_training_rows(asked, corpus, 2).first()["positive_id"] == "d1"
    assert A.hop_training_rows(asked, corpus, 1, "gmr").first()["query"] == "question"
    (plain,) = A.hop_training_rows(asked, corpus, 1, "dense").collect()
    assert (plain["query"], plain["positive_id"]) == ("question", "d3")


def test_span_passage_loss(spark):
    start, end = [0.2, 1.5, -0.3], [0.1, 0.4, 2.0]
    ce = lambda x, i: math.log(sum(map(math.exp, x))) - x[i]
    bce = lambda x, y: math.log1p(math.exp(-x if y else x))
    logits = spark.createDataFrame([(0, i, p, s, e) for i in (1, 2) for p, (s, e) in enumerate(zip(start, end))], "batch int, id int, position int, start_logit double, end_logit double")
    labels = spark.createDataFrame([(0, 1, 1, 2), (0, 2, 0, 0)], "batch int, id int, start int, end int")
    passages = spark.createDataFrame([(0, 1, 0.5, 1), (0, 1, -2.0, 0), (0, 2, 3.0, 0)], "batch int, id int, logit double, label int")
    row = A.span_passage_loss(logits, labels, passages).first()
    span = ((ce(start, 1) + ce(end, 2)) / 2 + (ce(start, 0) + ce(end, 0)) / 2) / 2
    flags = (bce(0.5, 1) + bce(-2.0, 0) + bce(3.0, 0)) / 3
    assert (row["span_loss"], row["passage_loss"], row["loss"]) == (pytest.approx(span), pytest.approx(flags), pytest.approx(span + 0.25 * flags))


def test_epoch_order_is_a_permutation(spark):
    rows = spark.range(0, 500, 1, 4).withColumnRenamed("id", "doc_id")
    one = {r["doc_id"]: r["position"] for r in A.epoch_order(rows, "doc_id", 42, 1).collect()}
    assert sorted(one.values()) == list(range(1, 501))
    assert one == {r["doc_id"]: r["position"] for r in A.epoch_order(rows.repartition(2), "doc_id", 42, 1).collect()}
    assert one != {r["doc_id"]: r["position"] for r in A.epoch_order(rows, "doc_id", 42, 2).collect()}


def test_moving_average(spark):
    row = spark.createDataFrame([(1.0, 3.0)], "t double, s double").select(A.moving_average(F.col("t"), F.col("s"), 0.9).alias("x")).first()
    assert row["x"] == pytest.approx(1.2)


def test_subsequences_are_copied_only_where_they_may_begin(spark):
    """A long needle costs little more than a short one where it can't begin."""
    many = F.sequence(F.lit(1), F.lit(1536)).cast("array<string>")
    rows = spark.range(600).select(many.alias("h"), F.array("id").cast("array<string>").alias("first")).select("h", *[F.concat(F.transform("first", lambda x: F.concat(F.lit("-"), x)), F.slice("h", 1, n)).alias(f"n{n}") for n in (1, 700)]).cache()
    rows.count()

    def seconds(n):
        found, start = rows.select(T.subsequence_at(F.col("h"), F.col(f"n{n}")).alias("at")), time.perf_counter()
        assert found.agg(F.count("at")).first()[0] == 0
        return time.perf_counter() - start

    seconds(1)
    assert min(seconds(700) for _ in range(2)) < 4 * min(seconds(1) for _ in range(2)) + 0.5
    cases = spark.createDataFrame([(["a", "b", "a", "c"], ["a", "c"]), (["a"], ["a", "b"]), (["a", "a"], []), ([None, "b"], [None, "b"])], "h array<string>, n array<string>")
    assert [r[0] for r in cases.select(T.subsequence_at(F.col("h"), F.col("n"))).collect()] == [2, None, None, 0]
