"""Ranked search over stored impacts against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import impacts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def plain(docs, items, k=10):
    counts = [(i, terms(t)) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    tokens = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for row, (doc, c) in enumerate(counts):
            m = 100 - 75 + (75 * sum(c.values()) * n) // tokens if c else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms(text).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, row, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, _, doc) in enumerate(sorted(scored)[:k])]
    return out


def found(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("row", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x"))
    return [tuple(r) for r in impacts.search(q, impacts.build_index(d, depth=k), k=k).collect()]


WORDS = ["the", "a", "The", "rare", "é", "Éa", "x1", "of", "of", "the", "the", "zebra", "ñu"]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ranks_match_brute_force(spark, k):
    rng = random.Random(k)
    vocabulary = WORDS + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    make = lambda n: " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, n)))
    docs = [(i, make(60)) for i in range(200)]
    items = [(i, make(12)) for i in range(25)] + [(90, "the"), (91, "the the of"), (92, "unknown"), (93, "zebra ñu the a")]
    assert sorted(found(spark, docs, items, k)) == sorted(plain(docs, items, k))


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "Rare é-x"), (3, "Rare é-x"), (None, "rare é"), (4, "the " * 50_000 + "rare"), (5, "a_b c"), (6, "é"), (7, "q" * 100_000)]
    items = [(1, "RARE x"), (1, "RARE x"), (2, None), (3, ""), (None, "é rare é"), (4, "the b"), (5, "Q" * 100_000)]
    assert sorted(map(repr, found(spark, docs, items))) == sorted(map(repr, plain(docs, items)))
    assert found(spark, docs, []) == [] == found(spark, [], items)
    with pytest.raises(ValueError):
        impacts.search(None, impacts.ImpactIndex(None, None, 0, 0, 5), k=6)


def test_words_that_all_documents_share_bring_no_candidates(spark):
    docs = spark.createDataFrame([(i, f"common shared word{i % 40} " * (1 + i % 3)) for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common shared word7")], "item_id long, text string")
    plan = impacts.search_plan(items, impacts.build_index(docs), "item_id", "text").collect()
    assert {r["term"]: r["needed"] for r in plan} == {"word7": True, "common": False, "shared": False}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1é _-\n", max_size=60), st.integers(1, 9))
def test_terms_of_any_text_in_pieces(text, piece):
    before = impacts.PIECE
    impacts.PIECE = piece
    try:
        assert impacts.term_counts(text.encode()) == Counter({t.encode(): n for t, n in terms(text).items()})
    finally:
        impacts.PIECE = before
