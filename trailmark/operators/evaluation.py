"""Ranking metrics, answer metrics and span decoding."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T

CUTOFFS = (1, 5, 10, 20, 100)


def per_query_metrics(qrels: DataFrame, rankings: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(query_id, k, recall, mrr, ndcg, map, complete_evidence).  A document's first
    rank counts, before the cut; a query without ranking scores 0."""
    judged = qrels.groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    first = rankings.groupBy("query_id", "doc_id").agg(F.min("rank").alias("at"))
    placed = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")))
    by_rank = Window.partitionBy("query_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    hits = placed.join(judged, ["query_id", "doc_id"]).withColumn("found", F.sum((F.col("gain") > 0).cast("int")).over(by_rank))
    ideal = judged.where("gain > 0").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")))
    total = judged.groupBy("query_id").agg(F.count_if(F.col("gain") > 0).alias("n"))
    discount = lambda r: F.log2(F.col(r) + 1.0)
    gained = (F.pow(F.lit(2.0), F.col("gain")) - 1)

    def at(c: Column, r: str, k: int, value: Column) -> Column:
        return F.sum(F.when((F.col(r) <= k) & c, value).otherwise(0.0))

    columns, ideals = [], []
    relevant = F.col("gain") > 0
    for k in cutoffs:
        columns += [
            at(relevant, "r", k, F.lit(1.0)).alias(f"hits{k}"), F.min(F.when((F.col("r") <= k) & relevant, F.col("r"))).alias(f"first{k}"),
            at(F.lit(True), "r", k, gained / discount("r")).alias(f"dcg{k}"), at(relevant, "r", k, F.col("found") / F.col("r")).alias(f"ap{k}"),
        ]
        ideals.append(at(F.lit(True), "i", k, gained / discount("i")).alias(f"idcg{k}"))
    wide = total.join(hits.groupBy("query_id").agg(*columns), "query_id", "left").join(ideal.groupBy("query_id").agg(*ideals), "query_id", "left")
    n = F.col("n")
    rows = F.array(*[
        F.struct(
            F.lit(k).cast("long").alias("k"),
            F.coalesce(F.col(f"hits{k}") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("recall"),
            F.coalesce(F.lit(1.0) / F.col(f"first{k}"), F.lit(0.0)).alias("mrr"),
            F.coalesce(F.col(f"dcg{k}") / F.nullif(F.col(f"idcg{k}"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
            F.coalesce(F.col(f"ap{k}") / F.nullif(F.least(F.lit(k), n), F.lit(0)), F.lit(0.0)).alias("map"),
            F.when((n > 0) & (F.col(f"hits{k}") == n), 1.0).otherwise(0.0).alias("complete_evidence"),
        )
        for k in cutoffs
    ])
    return wide.select("query_id", F.explode(rows).alias("m")).select("query_id", "m.*")


def ranking_metrics(qrels: DataFrame, rankings: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(k, num_queries, recall, mrr, ndcg, map, complete_evidence): macro means."""
    names = ["recall", "mrr", "ndcg", "map", "complete_evidence"]
    return per_query_metrics(qrels, rankings, cutoffs).groupBy("k").agg(F.count("*").alias("num_queries"), *[F.avg(m).alias(m) for m in names])


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two token arrays, a row of the table a step."""
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(above: Column, token: Column) -> Column:
        cells = F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda line, j: F.array_append(line, F.when(F.get(b, j - 1) == token, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(line, j - 1)))),
        )
        return cells

    return F.element_at(F.aggregate(a, start, row), -1)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """ROUGE-L F1 of normalised tokens; both empty 1, one empty 0."""

    def score(p: Column) -> Column:
        a, b = p["a"], p["b"]
        lcs = T.let(lcs_length(a, b), lambda n: 2.0 * n / (F.size(a) + F.size(b)))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(lcs)

    return T.let(F.struct(T.normalized_tokens(prediction).alias("a"), T.normalized_tokens(reference).alias("b")), score)


@F.pandas_udf(DoubleType())
def rouge_l_long(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """ROUGE-L for long texts: bit-parallel subsequence lengths."""

    def one(p: str, r: str) -> float:
        a, b = _tokens(p), _tokens(r)
        if not a or not b:
            return float(a == b)
        masks: dict[str, int] = {}
        for i, token in enumerate(a):
            masks[token] = masks.get(token, 0) | 1 << i
        full = (1 << len(a)) - 1
        row = full
        for token in b:
            match = row & masks.get(token, 0)
            row = ((row + match) | (row - match)) & full
        return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))

    return pd.Series([one(p, r) for p, r in zip(prediction, reference)], dtype="float64")


def _tokens(text: str | None) -> list[str]:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").lower()).strip().split()


def _pairs(p: list[tuple[int, str]], r: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Equal tokens paired from the end: the last with the last that is free.  What is paired
    leaves the lists."""
    places: dict[str, list[int]] = {}
    for j, token in r:
        places.setdefault(token, []).append(j)
    out = []
    for i, token in reversed(p):
        if places.get(token):
            out.append((i, places[token].pop()))
    left, right = {i for i, _ in out}, {j for _, j in out}
    p[:] = [x for x in p if x[0] not in left]
    r[:] = [x for x in r if x[0] not in right]
    return out


def meteor_one(prediction: str | None, reference: str | None, stems: bool = False, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR in stages: equal tokens, then, if wanted, equal stems of those that are left;
    F-mean and the penalty for scattered chunks."""
    a, b = _tokens(prediction), _tokens(reference)
    if a == b:
        return 1.0
    p, r = list(enumerate(a)), list(enumerate(b))
    pairs = _pairs(p, r)
    if stems:
        p, r = [(i, stem(t)) for i, t in p], [(j, stem(t)) for j, t in r]
        pairs += _pairs(p, r)
    if not pairs:
        return 0.0
    pairs.sort()
    precision, recall = len(pairs) / len(a), len(pairs) / len(b)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    chunks = 1 + sum(not (y[0] == x[0] + 1 and y[1] == x[1] + 1) for x, y in zip(pairs, pairs[1:]))
    return mean * (1 - gamma * (chunks / len(pairs)) ** beta)


@F.pandas_udf(DoubleType())
def meteor_exact(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """By equal tokens alone."""
    return pd.Series([meteor_one(p, r) for p, r in zip(prediction, reference)], dtype="float64")


@F.pandas_udf(DoubleType())
def meteor_stem(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """By equal tokens, then by equal stems."""
    return pd.Series([meteor_one(p, r, True) for p, r in zip(prediction, reference)], dtype="float64")


#: The endings of Porter's algorithm of 1980, by step.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel behind a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word by Porter's algorithm; two letters or fewer stay."""
    if len(word) <= 2:
        return word
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: len(word) - len(ending)] + to
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else ""
        if ending and "v" in _shape(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for endings in (dict(_STEP2), dict(_STEP3)):
        ending = _longest(word, endings)
        if ending and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + endings[ending]
    ending = _longest(word, _STEP4)
    if ending and _measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[: -len(ending)].endswith(("s", "t"))):
        word = word[: -len(ending)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if _doubled(word) and word.endswith("l") and _measure(word) > 1:
        word = word[:-1]
    return word


def decode_spans(logits: DataFrame, top: int = 20, longest: int = 512) -> DataFrame:
    """``logits(id, passage, position, start_logit, end_logit)`` to the best span of
    each id: (id, span_start, span_end, score)."""
    by = lambda c: Window.partitionBy("id").orderBy(F.desc(c), "position")
    starts = logits.withColumn("rs", F.row_number().over(by("start_logit"))).where(F.col("rs") <= top).select("id", "passage", F.col("position").alias("span_start"), "start_logit", "rs")
    ends = logits.withColumn("re", F.row_number().over(by("end_logit"))).where(F.col("re") <= top).select("id", "passage", F.col("position").alias("span_end"), "end_logit", "re")
    pairs = starts.join(ends, ["id", "passage"]).where((F.col("span_end") >= F.col("span_start")) & (F.col("span_end") - F.col("span_start") < longest))
    pairs = pairs.withColumn("score", F.round(F.col("start_logit") + F.col("end_logit"), 6))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "rs", "re")
    return pairs.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "span_start", "span_end", "score")
