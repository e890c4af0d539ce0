"""Lexical retrieval: the inverted index, two BM25 forms, overlap negatives.

The index is two tables: ``postings(bucket, term, doc_id, tf_title, tf_text, length)``,
which carry their passage's length, and ``vocabulary(bucket, term, df)``.  Every
passage has a posting without a term, so the number of passages and their mean
length come from the postings, too.  Queries are always answered as one set: their
terms join the postings by equality and scores are partial sums, so neither a
frequent term nor a popular document is gathered.  In a stored index a term's bucket
is a partition, and a search opens only the partitions of its queries' terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import durable

#: The term and the bucket of a passage's own posting.
PASSAGE, PASSAGES = "", -1
#: Words that are counted at a time; a passage's are counted together.
MOST_WORDS = 1 << 18
#: Pairs of query and passage that a task scores, on average at most; and the rows of a table
#: that is sent to every task.
PAIRS, FEW = 1 << 19, 1 << 20


def bucket_of(term: Column | str, buckets: int) -> Column:
    """The partition of a term."""
    term = F.col(term) if isinstance(term, str) else term
    return F.when(term == PASSAGE, F.lit(PASSAGES)).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets))).cast("int")


@dataclass
class LexicalIndex:
    postings: DataFrame
    vocabulary: DataFrame
    fold: str = "none"
    buckets: int = 64
    stored: bool = False
    corpus: DataFrame | None = None

    def size(self) -> int:
        """The number of passages; those of an index that is not stored are not cut for it."""
        return (self.postings.where(F.col("bucket") == PASSAGES) if self.corpus is None else self.corpus).count()

    def statistics(self) -> DataFrame:
        """One row (n, mean): passages and their mean length."""
        return self.postings.where(F.col("bucket") == PASSAGES).agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"))

    def words(self) -> DataFrame:
        """The postings of words."""
        return self.postings.where(F.col("bucket") != PASSAGES)

    def near(self, terms: DataFrame) -> LexicalIndex:
        """The index without the partitions that hold none of ``terms(term)``.  What the driver
        gets is the numbers of partitions."""
        if not self.stored:
            return self
        wanted = [r[0] for r in terms.select(bucket_of("term", self.buckets).alias("bucket")).distinct().collect()]
        only = F.col("bucket").isin([*wanted, PASSAGES])
        return LexicalIndex(self.postings.where(only), self.vocabulary.where(only), self.fold, self.buckets, True)


def top_k(scored: DataFrame, k: int | None, group: str = "query_id", item: str = "doc_id", digits: int | None = 6) -> DataFrame:
    """The ``k`` highest scores of each group with ``rank`` from 1, ties to the smaller
    item; None ranks all.  Scores are rounded first, so that the order of summation breaks no tie."""
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(group).orderBy(F.desc("score"), item)
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def build_index(passages: DataFrame, fold: str = "none", buckets: int = 64) -> LexicalIndex:
    """``passages(doc_id, title, text)``; all words are indexed, stopwords too, folded
    as ``functions.text.folded`` says, and queries are folded alike.  Ids are unique.
    Titles and texts are cut into words once."""
    counted = count_words(passages.select("doc_id", T.word_list(F.col("title"), fold).alias("a"), T.word_list(F.col("text"), fold).alias("b")))
    postings = counted.select(bucket_of("term", buckets).alias("bucket"), "term", "doc_id", "tf_title", "tf_text", "length")
    return LexicalIndex(postings, count_terms(postings), fold, buckets, corpus=passages.select("doc_id"))


def count_words(fields: DataFrame) -> DataFrame:
    """``fields(doc_id, a, b)``, words of titles and texts, to postings without buckets."""
    kind = fields.schema["doc_id"].dataType.simpleString()
    return fields.mapInArrow(_counted, f"term string, doc_id {kind}, tf_title long, tf_text long, length long")


def row_slices(sizes: np.ndarray, most: int):
    """Ranges of rows whose sizes add up to ``most`` at most, of one row at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield start, stop
        start = stop


def _counted(batches):
    """Passages' words, as lists, to their postings, within each batch: a passage is one row,
    so nothing is shuffled to count its words.  A batch is taken in slices of ``MOST_WORDS``,
    since the arrays of counting are many times as large as the words."""
    for whole in batches:
        held = [np.asarray(pc.list_value_length(whole.column(i)).fill_null(0), np.int64) for i in (1, 2)]
        for start, stop in row_slices(held[0] + held[1], MOST_WORDS):
            batch, sizes = whole.slice(start, stop - start), [s[start:stop] for s in held]
            yield _count_slice(batch, sizes)


def _count_slice(batch: pa.RecordBatch, sizes: list[np.ndarray]) -> pa.RecordBatch:
    n, sides = batch.num_rows, [batch.column(i) for i in (1, 2)]
    words = pa.chunked_array([pa.array([PASSAGE], pa.string()), *[c.flatten().cast(pa.string()) for c in sides]]).combine_chunks().dictionary_encode()
    codes = np.asarray(words.indices, np.int64)
    own = np.zeros(n, np.int64)  # the term of the passages themselves has code 0
    owner = np.concatenate([np.arange(n), *[np.repeat(np.arange(n), s) for s in sizes]])
    titled = np.concatenate([np.zeros(n), np.ones(sizes[0].sum()), np.zeros(sizes[1].sum())])
    terms = len(words.dictionary)
    keys, place = np.unique(owner * terms + np.concatenate([own, codes[1:]]), return_inverse=True)
    in_title = np.bincount(place, titled).astype(np.int64)
    row = pa.array(keys // terms)
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(pa.array(keys % terms)), batch.column(0).take(row), pa.array(in_title), pa.array(np.bincount(place) - in_title), pa.array((sizes[0] + sizes[1])[keys // terms])],
        names=["term", "doc_id", "tf_title", "tf_text", "length"],
    )


def count_terms(postings: DataFrame) -> DataFrame:
    """(bucket, term, df) of the words among postings."""
    return postings.where(F.col("bucket") != PASSAGES).groupBy("bucket", "term").agg(F.count("*").alias("df"))


def score_pairs(known: DataFrame, words: DataFrame, score: Column, passages: int) -> DataFrame:
    """(query_id, doc_id, score) of the pairs that share a term of ``known(query_id, term, ...)``
    and ``words(term, doc_id, ...)``: ``score`` is an aggregate over their columns.

    A query scores as many passages as hold its most frequent term, so pairs are far more
    than postings.  Postings of the queries' terms are dealt by passage, and meet the
    queries there: a task scores the pairs of its own passages, about ``PAIRS`` of them
    however large the corpus is, and a ranking's first rows are found before they move."""
    spark = known.sparkSession
    known = durable(spark)(known)
    rows, asked = known.agg(F.count("*"), F.count_distinct("query_id")).first()
    parts = max(1, min(-(-passages * asked // PAIRS), -(-passages // 64)), min(spark.sparkContext.defaultParallelism, passages // 256))
    if rows <= FEW:
        own = words.join(F.broadcast(known.select("term").distinct()), "term", "left_semi")
        met = own.repartition(parts, "doc_id").join(F.broadcast(known), "term")
    else:
        met = known.join(words, "term").repartition(parts, "doc_id")
    return met.groupBy("query_id", "doc_id").agg(score.alias("score"))


def without(scored: DataFrame, positives: DataFrame) -> DataFrame:
    """``scored`` without the pairs of ``positives(query_id, doc_id)``, which are sent to the
    pairs unless they are very many."""
    kept = durable(scored.sparkSession)(positives.select("query_id", "doc_id").distinct())
    return scored.join(F.broadcast(kept) if kept.count() <= FEW else kept, ["query_id", "doc_id"], "left_anti")


def bm25(queries: DataFrame, index: LexicalIndex, k: int | None = 10, max_terms: int | None = 4, title_weight: float = 2.0, text_weight: float = 1.0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) of ``queries(query_id, text)``: field-weighted
    BM25 over the ``max_terms`` rarest of each query's distinct terms; a ``k`` of None ranks all
    passages that share one."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.lexical_terms(F.col("text"), index.fold))).alias("term"))
    index = index.near(terms)
    known = terms.join(index.vocabulary.select("term", "df"), "term")
    if max_terms is not None:
        rare = Window.partitionBy("query_id").orderBy("df", "term")
        known = known.withColumn("r", F.row_number().over(rare)).where(F.col("r") <= max_terms).drop("r")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = known.crossJoin(F.broadcast(index.statistics())).select("query_id", "term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "mean")  # one row
    weight = F.col("tf_title") * title_weight + F.col("tf_text") * text_weight
    part = F.col("idf") * F.col("w") * (k1 + 1) / (F.col("w") + k1 * ((1 - b) + b * F.col("length") / F.col("mean")))
    return top_k(score_pairs(known, index.words().select("term", "doc_id", weight.alias("w"), "length"), F.sum(part), index.size()), k)


def okapi_negatives(queries: DataFrame, passages: DataFrame, positives: DataFrame, n: int = 8, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, most_tokens: int = 8192) -> DataFrame:
    """(query_id, doc_id, score, rank): the best Okapi-scored passages that are not
    among ``positives(query_id, doc_id)``; negative idf becomes ``epsilon`` times the
    mean idf.  Only passages that share a word with the query are candidates."""
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+", -1), lambda x: x != "")
    words = passages.select("doc_id", F.slice(split(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))), 1, most_tokens).alias("w"))
    counts = count_words(words.select("doc_id", F.array().cast("array<string>").alias("a"), F.col("w").alias("b"))).select("term", "doc_id", F.col("tf_text").alias("f"), "length")
    terms_of = durable(passages.sparkSession)(counts.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("mean")))
    own = terms_of.where(F.col("term") == PASSAGE).select(F.col("df").cast("double").alias("n"), "mean")
    vocabulary = terms_of.where(F.col("term") != PASSAGE).select("term", "df").crossJoin(F.broadcast(own))  # one row
    raw = vocabulary.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_idf = raw.agg(F.avg("idf").alias("mean_idf"))
    terms = queries.select("query_id", F.explode(split(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    known = terms.join(raw, "term").crossJoin(F.broadcast(mean_idf))
    known = known.withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf"))).select("query_id", "term", "times", "idf", "mean")
    part = F.col("times") * F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = score_pairs(known, counts, F.sum(part), passages.count())
    return top_k(without(scored, positives), n)


def overlap_negatives(queries: DataFrame, index: LexicalIndex, positives: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, doc_id, score, rank): passages by the number of distinct shared
    words, without the positives."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.word_list(F.col("text")))).alias("term"))
    scored = score_pairs(terms, index.near(terms).words().select("term", "doc_id"), F.count("*").cast("double"), index.size())
    return top_k(without(scored, positives), n)


def backfill(ranked: DataFrame, queries: DataFrame, passages: DataFrame, positives: DataFrame, n: int, seed: int) -> DataFrame:
    """Fills lists shorter than ``n`` with passages in the order of a seeded hash.
    Only short lists take part, and each needs at most ``n`` plus its own rows."""
    have = queries.select("query_id").join(ranked.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").fillna(0, ["have"]).where(F.col("have") < n)
    taken = ranked.select("query_id", "doc_id").unionAll(positives.select("query_id", "doc_id")).distinct()
    most = taken.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    pool = passages.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(int(n + most)).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    extra = have.crossJoin(F.broadcast(pool)).join(taken, ["query_id", "doc_id"], "left_anti")  # pool: n + most rows
    order = Window.partitionBy("query_id").orderBy("h", "doc_id")
    extra = extra.withColumn("rank", F.col("have") + F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("query_id", "doc_id", "score", "rank").unionAll(extra.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.col("rank").cast("long")))


def vocabulary(passages: DataFrame, column: str = "text") -> DataFrame:
    """(term, df) of the lexical terms of a column."""
    return passages.select("doc_id", F.explode(F.array_distinct(T.lexical_terms(F.col(column)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def positives_of(qrels: DataFrame) -> DataFrame:
    return qrels.where("gain > 0").select("query_id", "doc_id").distinct()


def best(scored: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return scored.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__r = 1").drop("__r")
