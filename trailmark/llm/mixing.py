"""Mixing sources to target weights, in DataFrame functions only.

Documents fall into cells (source, language, topic).  Iterative proportional
fitting rakes the cells' token weights to the target marginals of the three
dimensions in turn until all agree.  A cell's sampling rate is its raked weight
over its tokens; rates are scaled so that the largest is 1, which gives the
largest sample whose expected token shares meet the targets exactly.  One rare
category makes that sample tiny, as its cell has the largest rate; ``least``
states the share of all tokens that is expected at least.  Where the exact sample
holds less, rates are scaled to that size instead, cells with rates above 1 are
taken whole, and what they can't supply is raked over the others.  A document is
drawn when a hash of its id falls below its cell's probability, so draws need no
coordination and repeat.

The cells are the product of three category lists; documents are only ever
summed by partial aggregation and joined to their cell, so a source with a third
of all rows is no hot spot.

Defined results: null categories are the category ``(none)``; a null or empty
text has 0 tokens and its cell's probability (that of a cell without tokens is
1); rows with equal ids are drawn together; targets name shares of categories
that occur (others are ignored and the rest rescaled), and a category left out of
given targets gets the share 0.  Targets that no weights meet at once (one
dimension leaves out what another asks for) are met as nearly as the rounds come,
and the plan's ``gap`` is the largest distance between a category's share and its
target; ``most_gap`` makes a larger one an error.  Columns ``__tm_*`` of the input are
replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import NOT_SYMBOLS, WORD

DIMENSIONS = ("source", "lang", "topic")
#: Without explicit shares a dimension's target is its token share to this power,
#: renormalised: below 1 it lifts small categories.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
NONE = "(none)"
#: What ``mix_sources`` adds.
ADDED = ("tokens", *DIMENSIONS, "weight", "probability", "sampled")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A topic for tables that carry none: what form the text has."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_SYMBOLS, ""))
    return F.when(symbols * 10 > tokens, "markup").when(tokens < 100, "short").when(tokens < 600, "medium").otherwise("long")


def with_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tm_tokens`` and the cell columns ``__tm_<dimension>``."""
    out = docs.withColumn("__tm_tokens", n_tokens(F.col(text_col)))
    for d in DIMENSIONS:
        if d in docs.columns:
            out = out.withColumn(f"__tm_{d}", F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(NONE)))
        elif d == "topic":
            out = out.withColumn("__tm_topic", form_topic(F.col(text_col), F.col("__tm_tokens")))
        else:
            out = out.withColumn(f"__tm_{d}", F.lit(NONE))
    return out


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] = POWERS, rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """``cells(__tm_source, __tm_lang, __tm_topic, tokens)`` with ``weight``: raked
    shares that sum to 1 if the targets can be met, and ``gap``.  One small table is
    written each round."""
    spark = cells.sparkSession
    live = cells.where("tokens > 0")
    total = live.agg(F.sum("tokens").alias("total"))
    state = live.crossJoin(F.broadcast(total)).withColumn("weight", F.col("tokens") / F.col("total")).drop("total")  # total: one row
    wanted = {}
    for d in DIMENSIONS:
        key = f"__tm_{d}"
        if targets and d in targets:
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[d].items()], f"{key} string, want double")
            shares = live.select(key).distinct().join(given, key)
        else:
            shares = state.groupBy(key).agg(F.pow(F.sum("weight"), F.lit(powers.get(d, 1.0))).alias("want"))
        sum_ = shares.agg(F.sum("want").alias("sum"))
        wanted[d] = materialize(shares.crossJoin(F.broadcast(sum_)).select(key, (F.col("want") / F.col("sum")).alias("want")), f"target-{d}")
    few = state.count() <= 100_000  # in one partition, so that no round needs a shuffle
    local = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    state = local(materialize(state, "cells"))
    wanted = {d: local(w) for d, w in wanted.items()}
    state = _fit(state, wanted, local, rounds, tolerance)
    gaps = None
    for d, want in wanted.items():
        key = f"__tm_{d}"
        one = want.join(state.groupBy(key).agg(F.sum("weight").alias("have")), key, "left").agg(F.max(F.abs(F.col("want") - F.coalesce("have", F.lit(0.0)))).alias("gap"))
        gaps = one if gaps is None else gaps.unionByName(one)
    gap = gaps.agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))  # one row
    return materialize(state.crossJoin(F.broadcast(gap)), "raked")


def _fit(state: DataFrame, wanted: Mapping[str, DataFrame], local: Callable[[DataFrame], DataFrame], rounds: int, tolerance: float) -> DataFrame:
    for _ in range(rounds):
        step = state.withColumn("before", F.col("weight"))
        for d in DIMENSIONS:
            key = f"__tm_{d}"
            have = step.groupBy(key).agg(F.sum("weight").alias("have"))
            factor = wanted[d].join(have, key).select(key, F.try_divide("want", "have").alias("factor"))
            step = step.join(factor, key, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
        step = local(materialize(step, "cells"))
        moved = step.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0]
        state = step.drop("before")
        if moved is None or moved < tolerance:
            break
    return state


def calibrate(raked: DataFrame, least: float, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """``raked`` of ``rake`` with ``probability``; see ``least`` above.  Every pass but
    the last takes one more cell whole at least."""
    rate = F.col("weight") / F.col("tokens")
    one = raked.agg(F.max(rate).alias("top"), F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))).alias("live")).first()
    size = min(least * (one["tokens"] or 0), one["live"] or 0)  # a cell of weight 0 supplies nothing
    if not size or one["weight"] / one["top"] >= size:
        top = raked.agg(F.max(rate).alias("top"))  # one row
        return raked.crossJoin(F.broadcast(top)).withColumn("probability", F.least(rate / F.col("top"), F.lit(1.0))).drop("top")
    few = raked.count() <= 100_000
    local = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    rest, whole = raked.withColumn("raked", F.col("weight")), None
    left, sum_ = size, one["weight"]
    while True:
        part = rest.withColumn("expected", F.col("weight") * F.lit(left / sum_))
        part = local(materialize(part.withColumn("over", F.col("expected") > F.col("tokens")), "mix-expected"))
        full = part.where("over").withColumn("probability", F.lit(1.0))
        taken = full.agg(F.sum("tokens")).first()[0]
        open_ = part.where("not over")
        if taken is None or open_.where("weight > 0").isEmpty():
            break
        whole = full if whole is None else whole.unionByName(full)
        left = max(left - taken, 0.0)
        wanted = {}
        for d in DIMENSIONS:  # what a category's whole cells can't supply falls to its others, or to other categories
            key = f"__tm_{d}"
            want = part.groupBy(key).agg(
                F.sum(F.when(F.col("over"), F.col("expected") - F.col("tokens")).otherwise(F.col("expected"))).alias("want"),
                F.sum(F.when(~F.col("over"), F.col("expected"))).alias("open"),
            ).where("open > 0").select(key, "want")
            all_ = want.agg(F.sum("want").alias("sum"))
            wanted[d] = local(materialize(want.crossJoin(F.broadcast(all_)).select(key, (F.col("want") / F.col("sum")).alias("want")), f"target-{d}"))
        rest = _fit(open_.drop("expected", "over"), wanted, local, rounds, tolerance)
        sum_ = rest.agg(F.sum("weight")).first()[0]
    part = part.withColumn("probability", F.least(F.col("expected") / F.col("tokens"), F.lit(1.0)))
    every = part if whole is None else part.unionByName(whole)
    return every.drop("expected", "over", "weight").withColumnRenamed("raked", "weight")


def cell_probabilities(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] = POWERS, text_col: str = "text", least: float = 0.0, most_gap: float | None = None) -> DataFrame:
    """(cell columns, tokens, weight, probability, gap), a row per cell."""
    keys = [f"__tm_{d}" for d in DIMENSIONS]
    counted = with_cells(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in (*DIMENSIONS, text_col)]), text_col)
    cells = materialize(counted.groupBy(*keys).agg(F.sum("__tm_tokens").alias("tokens")), "mix-cells")
    raked = rake(cells, targets, powers)
    gap = raked.agg(F.max("gap")).first()[0] or 0.0
    if most_gap is not None and gap > most_gap:
        raise ValueError(f"the targets are not met: a category's share is {gap:.6f} off")
    if gap > 1e-3:
        warnings.warn(f"mixing: a category's share is {gap:.6f} off its target", stacklevel=2)
    found = calibrate(raked.drop("gap"), least).select(*keys, "weight", "probability")
    columns = [F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", F.lit(1.0)).alias("probability"), F.lit(gap).alias("gap")]
    return materialize(cells.join(found, keys, "left").select(*keys, "tokens", *columns), "mix-plan")


def draw(id_col: Column, seed: int = 1) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] = POWERS, seed: int = 1, least: float = 0.0, most_gap: float | None = None) -> DataFrame:
    """``docs`` with the columns ``__tm_source``, ``__tm_lang``, ``__tm_topic``,
    ``__tm_tokens``, ``__tm_weight``, ``__tm_probability`` and ``__tm_sampled``."""
    keys = [f"__tm_{d}" for d in DIMENSIONS]
    docs = docs.drop(*[f"__tm_{c}" for c in ADDED])
    plan = cell_probabilities(docs, targets, powers, text_col, least, most_gap)
    plan = plan.select(*keys, F.col("weight").alias("__tm_weight"), F.col("probability").alias("__tm_probability"))
    return with_cells(docs, text_col).join(plan, keys).withColumn("__tm_sampled", draw(F.col(id_col), seed) < F.col("__tm_probability"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The drawn rows with their own columns, whatever these are called."""
    narrow = {id_col, text_col, *(d for d in DIMENSIONS if d in docs.columns)}
    rows = docs.select(F.struct("*").alias("__row"), *[F.col(f"`{c}`") for c in sorted(narrow)])
    return mix_sources(rows, id_col, text_col, **settings).where("__tm_sampled").select("__row.*")
