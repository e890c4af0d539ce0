"""Exact vector search, late interaction and rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V
from .lexical import FEW, MOST_WORDS, PAIRS, row_slices, top_k


def _first_k(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, q))
    return order[np.arange(len(order)) - np.searchsorted(q[order], q[order], "left") < k]


def _tiles(n: int, most: int, parallel: int) -> int:
    """How many tiles ``n`` rows make, of ``most`` at most on average, for so many tasks."""
    return max(1, -(-n // most), min(parallel, n // 256))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int | None = 10, tile_bytes: int = 32 << 20, same_ids: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` largest inner products, exactly, for ids
    of any type.

    Queries and vectors are dealt into tiles of about ``tile_bytes``; each tile of
    queries meets each tile of vectors in one task, which keeps every query's own top
    ``k``, so what is shuffled on is k rows per query and tile of vectors.  A ``k`` of None ranks
    all pairs, of which a task gives ``PAIRS`` on average at most.  same_ids leaves a row out of
    its own list."""
    asked = queries.select("query_id", F.col("v").cast("array<double>").alias("v"))
    rows = vectors.select("doc_id", F.col("v").cast("array<double>").alias("v"))
    kind = StructType([asked.schema["query_id"], rows.schema["doc_id"], StructField("score", DoubleType())])
    width = rows.select(F.size("v")).first()
    most = max(1, tile_bytes // (8 * max(1, width[0] if width else 1)))
    n, m = asked.count(), rows.count()
    of_queries = max(1, -(-n // most))
    of_vectors = _tiles(m, most, max(1, rows.sparkSession.sparkContext.defaultParallelism // of_queries))
    if k is None:
        of_vectors = max(of_vectors, -(-n * m // (of_queries * PAIRS)))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", dealt(asked, of_queries)).withColumn("d", every(of_vectors))
    right = rows.withColumn("d", dealt(rows, of_vectors)).withColumn("q", every(of_queries))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names, docs = a["query_id"].combine_chunks(), b["doc_id"].combine_chunks()
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(names) and len(docs):
            x, y = (np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (a, b))
            own, ids = names.to_numpy(zero_copy_only=False), docs.to_numpy(zero_copy_only=False)
            held = []
            step = max(1, tile_bytes // (8 * len(docs)))
            for i in range(0, len(x), step):
                score = np.round(x[i : i + step] @ y.T, 6)
                if same_ids:
                    score[own[i : i + step, None] == ids[None, :]] = -np.inf
                if k is None:
                    q, d = np.nonzero(np.isfinite(score))
                    held.append((q + i, d, score[q, d]))
                    continue
                least = -np.partition(-score, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                q, d = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                score = score[q, d]
                first = _first_k(q, ids[d], score, k)
                held.append((q[first] + i, d[first], score[first]))
            best = tuple(np.concatenate(c) for c in zip(*held))
        return pa.table({"query_id": names.take(pa.array(best[0])), "doc_id": docs.take(pa.array(best[1])), "score": pa.array(best[2])})

    return top_k(left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInArrow(meet, kind), k)


def hashed_vectors(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 64) -> DataFrame:
    """(id, v): counts of a text's words in ``size`` places by a hash of the word, scaled
    to length 1, within each row; different words of a slice of rows are hashed once.  A stand-in
    for a neural encoder; a text without words has no vector."""
    read = rows.select(F.col(id_col).alias("id"), T.word_list(F.col(text_col)).alias("w")).where(F.size("w") > 0)

    def run(batches):
        for batch in (b.slice(start, stop - start) for b in batches for start, stop in row_slices(np.asarray(pc.list_value_length(b.column(1)), np.int64), MOST_WORDS)):
            n, words = batch.num_rows, batch.column(1).flatten().dictionary_encode()
            places = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % size for w in words.dictionary.to_pylist()], np.int64)
            owner = np.repeat(np.arange(n), np.asarray(pc.list_value_length(batch.column(1)), np.int64))
            counts = np.bincount(owner * size + places[np.asarray(words.indices)], minlength=n * size).reshape(n, size).astype(np.float64)
            v = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(v.ravel()))], names=["id", "v"])

    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, v array<double>").withColumnRenamed("id", id_col)


def maxsim_rerank(ranked: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, head: int = 20) -> DataFrame:
    """The first ``head`` of each list in the order of focused MaxSim, then the rest as
    it was: ``query_tokens(query_id, q)``, ``doc_tokens(doc_id, d)``: token vectors."""
    first = ranked.where(F.col("rank") <= head).select("query_id", "doc_id")
    scored = first.join(query_tokens, "query_id").join(doc_tokens, "doc_id").select("query_id", "doc_id", F.round(V.focused_maxsim(F.col("q"), F.col("d")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    scored = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    tail = ranked.where(F.col("rank") > head).select("query_id", "doc_id", "score", "rank")
    return scored.unionByName(tail)


def rrf_fuse_whole(*lists: DataFrame, constant: int = 60, depth: int = 100, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The first ``depth`` of ``rrf_fuse`` for lists that rank whole corpora and are durable.

    If a list has ``depth`` rows, as many pairs have 1 / (constant + depth) at least.  A pair that
    stands behind ``last`` in every list has less, and if no list has ``depth`` rows, there is none.
    So the others alone are fused, with their ranks in all lists, and whole lists are not shuffled."""
    last = len(lists) * (constant + depth) - constant
    near = None
    for one in lists:
        one = one.where(F.col("rank") <= last).select("query_id", "doc_id")
        near = one if near is None else near.unionAll(one)
    near = keep(near.distinct())
    met = F.broadcast(near) if near.count() <= FEW else near
    return rrf_fuse(*[one.join(met, ["query_id", "doc_id"], "left_semi") for one in lists], constant=constant, depth=depth)


def rrf_fuse(*lists: DataFrame, constant: int = 60, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists."""
    together = None
    for one in lists:
        one = one.select("query_id", "doc_id", (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("s"))
        together = one if together is None else together.unionAll(one)
    return top_k(together.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score")), depth or 1 << 30, digits=9)


def hybrid(first: DataFrame, second: DataFrame, depth: int = 100) -> DataFrame:
    return rrf_fuse(first, second, depth=depth)


def m3_fuse(first_hop: DataFrame, *later: DataFrame, depth: int = 100) -> DataFrame:
    """Fusion of the first hop with the fusion of the later ones."""
    return rrf_fuse(first_hop, rrf_fuse(*later), depth=depth) if later else rrf_fuse(first_hop, depth=depth)
