"""Checks across tables and runs: violations are rows, so that a caller can raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def validate(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(problem, id): queries without judgements or relevant documents, judgements
    without queries, relevant documents that the corpus lacks."""
    asked, judged = queries.select("query_id").distinct(), qrels.select("query_id").distinct()
    name = lambda df, problem, c: df.select(F.lit(problem).alias("problem"), F.col(c).cast("string").alias("id"))
    relevant = qrels.where("gain > 0")
    return (
        name(asked.join(judged, "query_id", "left_anti"), "query without judgements", "query_id")
        .unionAll(name(judged.join(asked, "query_id", "left_anti"), "judgements without query", "query_id"))
        .unionAll(name(relevant.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti"), "document not in corpus", "doc_id"))
        .unionAll(name(judged.join(relevant.select("query_id"), "query_id", "left_anti"), "query without relevant document", "query_id"))
    )


def require(violations: DataFrame, shown: int = 5) -> None:
    """Raises with the first few violations, if there are any."""
    rows = violations.orderBy(*violations.columns).limit(shown).collect()
    if rows:
        raise ValueError("; ".join(str(tuple(r)) for r in rows))


def same_queries(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Query ids in one table only, both ways."""
    a, b = rankings.select("query_id").distinct(), qrels.select("query_id").distinct()
    return a.join(b, "query_id", "left_anti").withColumn("only_in", F.lit("rankings")).unionAll(b.join(a, "query_id", "left_anti").withColumn("only_in", F.lit("qrels")))


def varying_columns(runs: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., column, values): columns that should be constant within a group, a null
    counting as a value of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("∅")).alias("value")) for c in columns]))
    rows = runs.select(*by, pairs.alias("p")).select(*by, "p.column", "p.value")
    return rows.groupBy(*by, "column").agg(F.countDistinct("value").alias("values")).where(F.col("values") > 1)


def unexpected(runs: DataFrame, expected: dict[str, object]) -> DataFrame:
    """Runs whose metadata differ from what is expected, null-safely."""
    bad = F.lit(False)
    for column, value in expected.items():
        bad = bad | ~F.col(column).eqNullSafe(F.lit(value))
    return runs.where(bad)


def summarize_seeds(runs: DataFrame, by: str = "method", seed: str = "seed") -> DataFrame:
    """``runs(method, seed, metric, value)``: (method, metric, n, mean, std) of metrics
    that all of a method's seeds have; the deviation of one seed is null."""
    seeds = runs.groupBy(by).agg(F.countDistinct(seed).alias("seeds"))
    stats = runs.groupBy(by, "metric").agg(F.count("value").alias("n"), F.count("*").alias("rows"), F.countDistinct(seed).alias("have"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return stats.join(seeds, by).where((F.col("n") == F.col("rows")) & (F.col("have") == F.col("seeds"))).select(by, "metric", "n", "mean", "std")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values in order, nulls marked."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]), 256)


def exact_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values in order, each with its length, so that no two rows give
    one text; a null differs from every value."""
    value = lambda c: F.col(c).cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in columns]), 256)


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest) of a table as a multiset: independent of row order and
    partitions, and each repetition of a row counts.  The digest is the SHA-256 of the
    number of rows and of four sums, each of 64 bits of every row's SHA-256."""
    digest = df.select(exact_digest(columns).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)"))
    sums = digest.agg(F.count("*").alias("rows"), *[F.coalesce(part(i), F.lit(0).cast("decimal(30,0)")).alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the bytes of every file that a path or pattern names; each
    is read by one task, so they must fit one."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
