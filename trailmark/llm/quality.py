"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a rejecting condition over features of the text.  On a sample the
cascade measures what each rule costs and how much it rejects, orders the rules
by rejection per cost and evaluates them as one CASE: once a rule has rejected,
later rules, and the features that only they use, are not computed.  Features that
are reported are computed of every row.  The order changes the work, never the
verdict.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results: a null or empty text has no
words, all features 0, and fails ``few_words``; rows are independent, so
repeated rows get repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_id

WORD = r"[^\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
WORDS = "__tm_words"


# -------------------------------------------------------------------- features


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_SYMBOLS, "")).cast("long")


def word_chars(word_list: Column) -> Column:
    return F.length(F.array_join(word_list, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_repeat_words(word_list: Column, k: int = 5) -> Column:
    """Words in k-word windows that a text holds twice or more.  Only a text with
    repeated window hashes goes on to sort them with their places, so any text
    takes n log n steps."""
    n = F.size(word_list)
    windows = F.when(n < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(word_list, i + j) for j in range(k)]))
    )

    def covered(starts: Column) -> Column:
        steps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), starts, lambda b, a: F.least(F.lit(k), F.coalesce(b - a, F.lit(k))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(found: Column) -> Column:
        by_hash = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = lambda s: F.array_sort(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"])),
                lambda j: F.get(s, j)["i"],
            )
        )
        return _let(by_hash, lambda s: _let(places(s), covered))

    return _let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeated(g))).cast("long")


def features(text: Column, word_list: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(word_list).cast("long"),
        "word_chars": word_chars(word_list),
        "n_symbols": n_symbols(text),
        "n_lines": n_lines(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(word_list),
    }


# --------------------------------------------------------------------- cascade


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda f: f["n_words"] < 10),
    Rule("repeated_words", lambda f: f["n_repeat_words"] * 100 > f["n_words"] * 20),
)
MORE_RULES = (
    Rule("word_length", lambda f: (f["word_chars"] < f["n_words"] * 2) | (f["word_chars"] > f["n_words"] * 25)),
    Rule("symbols", lambda f: f["n_symbols"] * 10 > f["n_words"] * 4),
    Rule("repeated_lines", lambda f: (f["n_dup_lines"] > 0) & (f["n_dup_lines"] * 10 > f["n_lines"] * 4)),  # without repeats lines need no count
)
RULES = BASE_RULES + MORE_RULES


def _with_words(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn(WORDS, words(F.col(text_col)))


#: Bounds of the sample that orders the rules: so many rows, of each so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 512, 1 << 14


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", reported: tuple[str, ...] = (), repeats: int = 8) -> list[Rule]:
    """The rules by rejections per second on a sample: the head of the table, so that a
    table of many files is not opened for it, at most ``SAMPLE_ROWS`` texts of which the
    first ``SAMPLE_CHARS`` characters are taken.  A rule's cost is the best of three
    runs over ``repeats`` copies of the sample, less that of a run without a rule;
    features that are ``reported`` cost it nothing, as every row has them."""
    head = docs.select(F.substring(text_col, 1, SAMPLE_CHARS)).head(SAMPLE_ROWS)
    sample = docs.sparkSession.createDataFrame([(row[0],) for row in head], f"`{text_col}` string").crossJoin(docs.sparkSession.range(repeats).select())  # bounded
    sample = _with_words(sample, text_col)
    of = features(F.col(text_col), F.col(WORDS))
    sample = sample.select(text_col, WORDS, *[of[c].alias(f"__tm_{c}") for c in reported]).persist()
    of |= {c: F.col(f"__tm_{c}") for c in reported}

    def best(condition: Column) -> tuple[float, int, int]:
        runs = []
        for _ in range(3):  # the first run compiles
            start = time.perf_counter()
            rejected, total = sample.agg(F.count_if(condition), F.count("*")).first()
            runs.append(time.perf_counter() - start)
        return min(runs), rejected, total

    try:
        sample.count()
        idle = best(F.col(text_col).isNull())[0]
        rates = {}
        for rule in rules:
            took, rejected, total = best(rule.rejects(of))
            rates[rule.name] = (rejected + 0.5) / (total + 1) / max(took - idle, 1e-4)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -rates[r.name])


def verdict(order: list[Rule], of: Mapping[str, Column]) -> Column:
    """The name of the first rule in ``order`` that rejects, or null."""
    case = None
    for rule in order:
        condition = F.coalesce(rule.rejects(of), F.lit(False))
        case = F.when(condition, rule.name) if case is None else case.when(condition, rule.name)
    return F.lit(None).cast("string") if case is None else case


#: The features that ``score_quality`` reports; others are behind the cascade.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, reported: tuple[str, ...] = REPORTED) -> DataFrame:
    """(id, the reported features, rejected_by) of every row.  An id column named like one
    of these keeps its name, and that result gets a trailing underscore."""
    order = cascade_order(docs, rules, text_col, reported)
    found = _with_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__tm_text")), "__tm_text")
    of = features(F.col("__tm_text"), F.col(WORDS))
    found = found.select("id", "__tm_text", WORDS, *[of[c].alias(c) for c in reported])
    lazy = {c: x for c, x in features(F.col("__tm_text"), F.col(WORDS)).items() if c not in reported}
    return with_id(found.select("id", *reported, verdict(order, {**lazy, **{c: F.col(c) for c in reported}}).alias("rejected_by")), id_col)


def filter_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns; features are
    computed only as far as the cascade goes."""
    order = cascade_order(docs, rules, text_col)
    text = F.col(text_col)
    reason = _let(words(text), lambda w: verdict(order, features(text, w)))  # a filter on a column would be pushed below it
    return docs.where(reason.isNull())
