"""Tokenised inputs, batches and model-side scores against plain versions."""

import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import vectors as V
from trailmark.operators import evaluation
from trailmark.plans import model_inputs as M
from trailmark.plans import pipelines

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12), st.integers(0, 3))
def test_alignment_matches_all_pairs(gaps, sizes, repeat):
    words, at = [], 0
    for g, n in zip(gaps, sizes):
        words.append((at + g, at + g + n + 1))
        at += g + n + 1
    offsets, at = [], 0
    for n in sizes[::-1]:
        offsets += [(at, at + n)] * (1 + (n + repeat) % 3)  # a character of several tokens
        at += n
    assert M.align(words, offsets) == [[i for i, (a, b) in enumerate(offsets) if a < e and b > s] for s, e in words]


def example(spark):
    texts = [["Luật", "đất", "đai", ",", "điều", "5", "."], ["naïve", "(", "x", ")", "héllo", "😀", "end"]]
    passages = [(0, 6, True), (7, 13, False)]
    return spark.createDataFrame([("q", "Câu hỏi ?", texts[0] + texts[1], passages, 1, 4), ("p", "x", texts[0] + texts[1], passages, 12, 13)],
                                 "query_id string, question string, flat_tokens array<string>, passages array<struct<global_start:int,global_end:int,is_answer_passage:boolean>>, start_position int, end_position int")


def test_span_inputs(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BPE)
    rows = {(r["query_id"], r["passage"]): r for r in M.span_inputs(example(spark), BPE, M.Layout((7,), (8, 8), (9,), 64)).collect()}
    r = rows["q", 0]
    question, passage = tool.encode("Câu hỏi ?", add_special_tokens=False), tool.encode("Luật đất đai, điều 5.", add_special_tokens=False)
    assert r["input_ids"] == [7, *question.ids, 8, 8, *passage.ids, 9] and r["is_answer_passage"] and r["mapped"]
    head = len(question.ids) + 3
    assert r["positions"][:head] == [-1] * head and r["positions"][-1] == -1
    assert sorted({x for x in r["positions"] if x >= 0}) == list(range(7)) and sorted({x for x in rows["q", 1]["positions"] if x >= 0}) == list(range(7, 14))
    label = tool.decode(r["input_ids"][r["start"] : r["end"] + 1])
    assert label.strip() == "đất đai, điều" and rows["q", 1]["start"] is None
    other = rows["p", 1]
    assert tool.decode(other["input_ids"][other["start"] : other["end"] + 1]).strip() == "😀 end" and rows["p", 0]["start"] is None


def test_inputs_are_cut_on_the_passage_side(spark):
    n = 3 + len(__import__("tokenizers").Tokenizer.from_file(BPE).encode("Câu hỏi ?", add_special_tokens=False).ids)
    made = M.span_inputs(example(spark).where("query_id = 'q'"), BPE, M.Layout((7,), (8,), (9,), n + 2))
    rows = made.orderBy("passage").collect()
    assert all(len(r["input_ids"]) == n + 2 and r["input_ids"][-1] == 9 for r in rows) and not rows[0]["mapped"]
    with pytest.raises(ValueError, match="beyond"):
        M.require_mapped(made)
    M.require_mapped(M.span_inputs(example(spark), BPE))
    with pytest.raises(Exception, match="no room"):
        M.span_inputs(example(spark), BPE, M.Layout(longest=3)).collect()
    assert M.span_inputs(example(spark).where("false"), BPE).count() == 0


def test_batches(spark):
    rng = random.Random(2)
    pairs = spark.createDataFrame([(i, "word " * rng.randint(0, 120), None if i % 50 == 0 else "yes " * rng.randint(1, 9)) for i in range(203)], "id long, source string, target string")
    made = M.sequence_batches(pairs, BPE, 8, 64, 6, pad=0, end=50256)
    rows = made.collect()
    assert sorted(i for r in rows for i in r["ids"]) == list(range(203))
    for r in rows:
        assert len(r["ids"]) <= 8 and len({len(x) for x in r["input_ids"]}) == len({len(x) for x in r["labels"]}) == 1
        for a, m, b in zip(r["input_ids"], r["attention_mask"], r["labels"]):
            assert sum(m) <= 64 and len(b) <= 6 and a[sum(m) - 1] == 50256 and not any(a[sum(m) :]) and m == sorted(m, reverse=True)
            assert [x for x in b if x != M.IGNORED][-1] == 50256 and b == sorted(b, key=lambda x: x == M.IGNORED)
    assert M.padding_share(made).first()[0] < 0.05
    again = M.sequence_batches(pairs, BPE, 8, 64, 6, pad=0, end=50256, epoch=1)
    assert [r["ids"] for r in made.orderBy("batch").collect()] != [r["ids"] for r in again.orderBy("batch").collect()]
    assert M.sequence_batches(pairs.where("false"), BPE).count() == 0


# ------------------------------------------------------------------------- scores


def test_stems():
    """Pairs that Porter's paper gives."""
    pairs = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
    falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic
    differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
    sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
    airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler
    probate probat rate rate cease ceas controll control roll roll""".split()
    for word, want in zip(pairs[::2], pairs[1::2]):
        assert evaluation.stem(word) == want, word
    assert evaluation.stem("at") == "at" and evaluation.stem("người") == "người"


def plain_meteor(a, b, stems):
    """The alignment by its definition: from the end of both, stage by stage."""
    p, r, pairs = list(enumerate(a)), list(enumerate(b)), []
    for form in [lambda t: t] + ([evaluation.stem] if stems else []):
        for i in range(len(p))[::-1]:
            for j in range(len(r))[::-1]:
                if form(p[i][1]) == form(r[j][1]):
                    pairs.append((p.pop(i)[0], r.pop(j)[0]))
                    break
    if a == b:
        return 1.0
    if not pairs:
        return 0.0
    pairs.sort()
    chunks, k = 1, len(pairs)
    for x, y in zip(pairs, pairs[1:]):
        chunks += (y[0] - x[0], y[1] - x[1]) != (1, 1)
    precision, recall = k / len(a), k / len(b)
    return precision * recall / (0.9 * precision + 0.1 * recall) * (1 - 0.5 * (chunks / k) ** 3)


WORDS = st.lists(st.sampled_from(["run", "runs", "running", "a", "b", "hope", "hoping", "hopeful"]), max_size=10)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS)
def test_meteor_matches_its_definition(a, b):
    for stems in (False, True):
        assert evaluation.meteor_one(" ".join(a), " ".join(b), stems) == pytest.approx(plain_meteor(a, b, stems))


def test_meteor_stem_column(spark):
    row = spark.createDataFrame([("the cats ran", "the cat ran", None)], "a string, b string, c string").select(evaluation.meteor_stem(F.col("a"), F.col("b")).alias("s"), evaluation.meteor_exact(F.col("a"), F.col("b")).alias("e"), evaluation.meteor_stem(F.col("c"), F.col("b")).alias("n")).first()
    assert row["s"] == pytest.approx(1 - 0.5 / 27) and row["e"] < row["s"] and row["n"] == 0


def test_token_matching(spark):
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    rows = [(i, [vector() for _ in range(rng.randint(0, 4))], [vector() for _ in range(rng.randint(0, 4))]) for i in range(30)]
    rows = [(i, p, r, [rng.random() for _ in p], [rng.random() for _ in r]) for i, p, r in rows]
    df = spark.createDataFrame(rows, "id int, p array<array<double>>, r array<array<double>>, wp array<double>, wr array<double>")
    got = {x["id"]: x["m"] for x in df.select("id", V.token_match(F.col("p"), F.col("r"), F.col("wp"), F.col("wr")).alias("m")).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    side = lambda a, b, w: sum(max(cos(x, y) for y in b) * v for x, v in zip(a, w)) / sum(w) if a and b else 0.0
    for i, p, r, wp, wr in rows:
        precision, recall = side(p, r, wp), side(r, p, wr)
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        assert (got[i]["precision"], got[i]["recall"], got[i]["f1"]) == (pytest.approx(precision), pytest.approx(recall), pytest.approx(f1))


def test_answers_are_matched_by_token_vectors(spark):
    def encode(rows):
        tokens = T.word_list(F.col("text"))
        return rows.select("id", tokens.alias("tokens"), F.transform(tokens, lambda t: F.array((t == "a").cast("double"), (t == "b").cast("double"), (~t.isin("a", "b")).cast("double"))).alias("vectors"))

    rows = spark.createDataFrame([(1, "a b", "a b"), (2, "a c", "a a"), (3, "", "b")], "query_id int, prediction string, reference string")
    got = {r["query_id"]: r for r in pipelines.token_match_scores(rows, encode).collect()}
    idf = {t: math.log(4 / (n + 1)) for t, n in (("a", 2), ("b", 2), ("c", 0))}
    assert got[1]["f1"] == pytest.approx(1) and got[2]["recall"] == pytest.approx(1) and got[2]["precision"] == pytest.approx(idf["a"] / (idf["a"] + idf["c"])) and got[3]["f1"] == 0
    means = pipelines.answer_metrics(rows, encode).first()
    assert means["bertscore_f1"] == pytest.approx(sum(r["f1"] for r in got.values()) / 3) and pipelines.answer_metrics(rows).first()["bertscore_f1"] is None


def test_a_batch_is_tokenised_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(90)), pa.array(["q" * 100] * 90), pa.array(["w " * 5000] * 89 + [""])], names=["query_id", "question", "text"])
    parts = list(M._parts(batch, "question", "text"))
    assert [i for p in parts for i in p["query_id"].to_pylist()] == list(range(90))
    assert len(parts) > 1 and all(sum(len(q) + len(t) for q, t in zip(p["question"].to_pylist(), p["text"].to_pylist())) <= M.MOST_CHARS for p in parts)
