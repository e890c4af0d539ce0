"""Ranked lexical search by a threshold-seeded join over stored impacts.

The index holds a posting for every term of every document and, for every term,
its weight, its largest and its k-th largest impact.  What a document scores by
one term alone is a lower bound of its score, so the k-th impact of any of an
item's terms, times the term's weight, is a lower bound of the item's k-th
score: the threshold that the join starts with.  An item's terms are ordered by
the most that each can add; where all the terms from a place on add less than
the threshold, a document that holds only those can't be among the k best, so
they bring no candidates.  The others' postings are joined and summed; the k-th
partial sum may raise the threshold, candidates that can't reach it even with
all that the left-out terms may add are dropped, and the few that are left are
scored exactly with the left-out terms' postings.  No bound drops a document
that could be among the k best, ties included.

Scores are 64-bit integers: a term's weight is floor(1000 ln((2N+2)/(2df+1))),
its impact in a document (10^9 tf) div (1000 tf + 8 m) with
m = 25 + (75 n N) div L.

Defined results: terms are runs of ASCII letters and digits and of everything
that is not ASCII, A-Z lower-cased; a null or empty text has none; texts are
read whole; every row of the documents ranks by itself, so repeated rows stand
next to each other (ties go to the smaller id, a null id behind all others);
every row of the items is ranked by itself, too; only scores above 0 are listed;
an empty table on either side gives no rows; other columns of any name may
stand beside ids and texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bits_for, key_bits, materialize, slices, split_by_bits, text_buffer, trimmed

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text whose postings are made at a time, and bytes that are cut into words at a time.
SLICE, PIECE = 1 << 20, 4 << 20


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term occurs, read in pieces that end between terms."""
    out: Counter[bytes] = Counter()
    start = 0
    while start < len(text):
        piece = text[start : start + PIECE].translate(_TERMS)
        if start + PIECE < len(text):
            cut = piece.rfind(b" ") + 1
            while not cut:  # one term fills the piece
                more = text[start + len(piece) : start + len(piece) + PIECE].translate(_TERMS)
                piece, cut = piece + more, len(piece) + more.find(b" ") + 1 if b" " in more or not more else 0
            piece = piece[:cut]
        out.update(piece.split())
        start += len(piece)
    return out


def postings_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, row, n, tf, lead): a posting for every term of every row; ``row`` tells
    rows apart, ``n`` counts a row's terms with repeats, ``lead`` is 1 once a row."""
    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    source = source.select("id", "row", "text")
    longs = [T.StructField(c, T.LongType()) for c in ("n", "tf")]
    schema = T.StructType([T.StructField("term", T.StringType()), source.schema["id"], T.StructField("row", T.LongType()), *longs, T.StructField("lead", T.IntegerType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for start, stop in slices(offsets, SLICE):
                counts = [term_counts(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(start, stop)]
                sizes = np.array([len(c) for c in counts], np.int64)
                if not sizes.sum():
                    continue
                of = np.repeat(np.arange(start, stop), sizes)
                lead = np.zeros(len(of), np.int32)
                lead[(np.cumsum(sizes) - sizes)[sizes > 0]] = 1
                terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
                tf = np.fromiter((x for c in counts for x in c.values()), np.int64, len(of))
                n = np.repeat([sum(c.values()) for c in counts], sizes).astype(np.int64)
                taken = pa.array(of)
                yield pa.RecordBatch.from_arrays([terms, batch.column(0).take(taken), batch.column(1).take(taken), pa.array(n), pa.array(tf), pa.array(lead)], names=schema.names)

    return source.mapInArrow(trimmed(run), schema)


@dataclass
class ImpactIndex:
    """``postings(term, id, row, n, tf)``; ``terms(term, df, weight, most, kth)``; the
    number of documents with terms and of all their terms; the depth of ``kth``."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    tokens: int
    depth: int

    def impact(self) -> Column:
        return _impact(self.documents, self.tokens)


def _impact(documents: int, tokens: int) -> Column:
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {documents}L) div {max(tokens, 1)}L))")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 10) -> ImpactIndex:
    """The index of whole texts.  A term's largest impacts are taken in every partition
    first, so a term that all documents hold sends ``depth`` rows from each."""
    postings = materialize(postings_of(docs, id_col, text_col), "postings")
    documents, tokens = postings.agg(F.coalesce(F.sum("lead"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("term").orderBy(F.desc("impact"))
    top = postings.select("term", _impact(documents, tokens).alias("impact")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= depth)
    best = top.groupBy("term").agg(F.max("impact").alias("most"), F.coalesce(F.min(F.when(F.col("r") == depth, F.col("impact"))), F.lit(0)).alias("kth"))
    weight = F.floor(F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)) * 1000)
    terms = counts.join(best, "term").select("term", "df", weight.cast("long").alias("weight"), "most", "kth")
    return ImpactIndex(postings.drop("lead"), materialize(terms, "terms"), documents, tokens, depth)


def search_plan(items: DataFrame, index: ImpactIndex, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, gain, needed, theta, rest): an item's known terms with what one
    unit of impact adds, whether the term brings candidates, the item's threshold, and
    the most that its terms without candidates add."""
    asked = postings_of(items, id_col, text_col).select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", F.col("tf").alias("times"))
    known = asked.join(index.terms, "term").withColumn("gain", F.col("times") * F.col("weight"))
    known = known.withColumn("most", F.col("gain") * F.col("most")).withColumn("least", F.col("gain") * F.col("kth"))
    item = Window.partitionBy("item")
    onward = item.orderBy(F.desc("most"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = known.withColumn("theta", F.max("least").over(item)).withColumn("onward", F.sum("most").over(onward))
    known = known.withColumn("needed", (F.col("onward") >= F.col("theta")) & (F.col("onward") > 0))
    rest = F.sum(F.when(F.col("needed"), F.lit(0)).otherwise(F.col("most"))).over(item)
    return known.select("item", "item_id", "term", "gain", "needed", "theta", rest.alias("rest"))


def search(items: DataFrame, index: ImpactIndex, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` rows of the index with the highest scores
    above 0 for every row of ``items``; ``k`` may not exceed the index's depth."""
    if not 1 <= k <= index.depth:
        raise ValueError(f"this index holds the impacts of the first {index.depth}")
    plan = materialize(search_plan(items, index, id_col, text_col), "plan")
    gained = F.col("gain") * F.col("impact")
    postings = index.postings.select("term", "row", "id", index.impact().alias("impact"))
    seeds = plan.where("needed").join(postings, "term").groupBy("item", "row").agg(F.sum(gained).alias("partial"), F.first("id").alias("id"))
    seeds = materialize(seeds, "candidates")
    by_partial = Window.partitionBy("item").orderBy(F.desc("partial"))
    kth = seeds.select("item", "partial").withColumn("r", F.row_number().over(by_partial)).where(F.col("r") <= k).where(F.col("r") == k).select("item", F.col("partial").alias("seen"))
    bounds = plan.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("theta").alias("theta"), F.first("rest").alias("rest")).join(kth, "item", "left")
    bounds = bounds.withColumn("theta", F.greatest("theta", F.coalesce("seen", F.lit(0)))).drop("seen")
    alive = materialize(seeds.join(bounds, "item").where(F.col("partial") + F.col("rest") >= F.col("theta")).drop("theta", "rest"), "alive")
    bits = bits_for(alive.count())
    near = split_by_bits(postings.drop("id"), key_bits(alive, "row", bits), "row", True, bits)  # spares rows the next join
    others = alive.select("item", "row").join(plan.where(~F.col("needed")).select("item", "term", "gain"), "item")
    added = others.join(near, ["term", "row"]).groupBy("item", "row").agg(F.sum(gained).alias("added"))
    scored = alive.join(added, ["item", "row"], "left").withColumn("score", F.col("partial") + F.coalesce("added", F.lit(0))).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
