"""Vector functions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def pooled_mean(tokens: Column, mask: Column, least: float = 1e-12) -> Column:
    """Mean of the token vectors whose mask is 1, scaled to length 1; a length below ``least``
    counts as ``least``, and if that is 0, a vector of zeros has no direction: NaN."""
    live = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m > 0, t)), lambda t: t.isNotNull())
    none = F.when(F.size(live) > 0, F.lit(-0.0)).otherwise(F.lit(0.0))  # -0.0 + x is x, also if x is -0.0
    total = F.aggregate(live, F.transform(F.get(tokens, F.lit(0)), lambda x: none), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(live), F.lit(1)))
    return F.get(F.transform(F.array(mean), lambda m: scaled(m, F.greatest(norm(m), F.lit(least)))), F.lit(0))


def scaled(v: Column, length: Column) -> Column:
    """A vector by its length, NaN if that is 0."""
    return F.get(F.transform(F.array(length), lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, n)))), F.lit(0))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded in binary as DuckDB rounds it: half away from zero after scaling, with
    the sign kept at 0.  ``F.round`` goes by decimal digits and has no -0.0."""
    size = F.abs(x) * F.lit(float(10**digits))
    whole = F.floor(size).cast("double")
    up = F.when(size - whole >= 0.5, whole + 1.0).otherwise(whole) / F.lit(float(10**digits))
    return F.when(F.isnan(x) | (size >= 2.0**52), x).when(up == 0, x * 0.0).when(x < 0, -up).otherwise(up)


def focused_maxsim(query: Column, document: Column, fraction: float = 0.4) -> Column:
    """Sum of the best ``fraction`` of the query tokens' highest cosines with any
    document token."""
    unit = lambda c: F.transform(c, lambda t: F.get(F.transform(F.array(F.greatest(norm(t), F.lit(1e-12))), lambda n: F.transform(t, lambda x: x / n)), F.lit(0)))

    def score(q: Column, d: Column) -> Column:
        best = F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y))))
        keep = F.greatest(F.lit(1), F.ceil(F.size(q) * fraction)).cast("int")
        return F.aggregate(F.slice(F.sort_array(best, asc=False), F.lit(1), keep), F.lit(0.0), lambda s, x: s + x)

    return F.get(F.transform(F.array(F.struct(unit(query).alias("q"), unit(document).alias("d"))), lambda p: score(p["q"], p["d"])), F.lit(0))


def token_match(prediction: Column, reference: Column, prediction_weights: Column | None = None, reference_weights: Column | None = None) -> Column:
    """(precision, recall, f1) by greedy matching of token vectors: each of the prediction's
    tokens with its nearest of the reference's by cosine, and the other way round, averaged
    by the tokens' weights (all alike, if none are given).  A side without tokens, or
    without weight, scores 0."""
    unit = lambda c: F.transform(c, lambda t: F.get(F.transform(F.array(F.greatest(norm(t), F.lit(1e-12))), lambda n: F.transform(t, lambda x: x / n)), F.lit(0)))
    even = lambda c: F.transform(c, lambda _: F.lit(1.0))

    def side(a: Column, b: Column, weights: Column) -> Column:
        best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
        total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
        gained = F.aggregate(F.zip_with(best, weights, lambda x, w: F.coalesce(x, F.lit(0.0)) * w), F.lit(0.0), lambda s, x: s + x)
        return F.when(total > 0, gained / total).otherwise(F.lit(0.0))

    def score(x: Column) -> Column:
        return F.struct(side(x["p"], x["r"], x["wp"]).alias("precision"), side(x["r"], x["p"], x["wr"]).alias("recall"))

    def with_f1(x: Column) -> Column:
        both = x["precision"] + x["recall"]
        return F.struct(x["precision"].alias("precision"), x["recall"].alias("recall"), F.when(both != 0, 2 * x["precision"] * x["recall"] / both).otherwise(F.lit(0.0)).alias("f1"))

    wp = even(prediction) if prediction_weights is None else prediction_weights
    wr = even(reference) if reference_weights is None else reference_weights
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return once(F.struct(unit(prediction).alias("p"), unit(reference).alias("r"), wp.alias("wp"), wr.alias("wr")), lambda x: once(score(x), with_f1))
