"""Hop-by-hop retrieval.  The only driver-side loop is over hops (three at most)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dense import m3_fuse, rrf_fuse
from .lexical import best

#: Fixed value: what stands before the facts of earlier hops.
SO_FAR = "\nEvidence so far: "
#: The parts of the reasoning prompt.
REASONING_HEAD = "Given the legal question and retrieved evidence, write only the next concise reasoning sentence needed to find another relevant legal passage. Do not answer yet.\nQuestion: "
REASONING_EVIDENCE = "\nEvidence:\n"
REASONING = "\nReasoning so far: "
REASONING_END = "\nNext sentence:"

Retriever = Callable[[DataFrame], DataFrame]
#: A reasoner takes (query_id, text, evidence, prompt) and gives (query_id, line): the
#: text that it writes, of which the first line counts.
Reasoner = Callable[[DataFrame], DataFrame]


def hop_queries(state: DataFrame) -> DataFrame:
    """The question and its last three facts."""
    recent = F.slice("history", F.greatest(F.size("history") - 2, F.lit(1)), 3)
    asked = F.when(F.size("history") > 0, F.concat("text", F.lit(SO_FAR), F.array_join(recent, " "))).otherwise(F.col("text"))
    return state.select("query_id", asked.alias("text"))


def greedy_hops(queries: DataFrame, retrieve: Retriever, passages: DataFrame, hops: int = 3, rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[DataFrame]:
    """The ranking of every hop.  After each hop the best document not seen before
    gives a fact, which the next hop's query carries.  ``rerank`` reorders every
    hop's list, given the list and the hop's queries; ``keep`` makes an intermediate
    table durable.  Ids may be of any type."""
    none = F.array().cast(f"array<{passages.schema['doc_id'].dataType.simpleString()}>")
    state = queries.select("query_id", "text", none.alias("seen"), F.array().cast("array<string>").alias("history"))
    lists: list[DataFrame] = []
    for hop in range(hops):
        asked = hop_queries(state)
        ranked = retrieve(asked)
        ranked = keep(rerank(ranked, asked) if rerank else ranked)
        lists.append(ranked)
        if hop + 1 == hops:
            break
        fresh = ranked.join(state.select("query_id", "seen"), "query_id").where(~F.array_contains("seen", F.col("doc_id")))
        chosen = best(fresh, "query_id", [F.col("rank"), F.col("doc_id")]).select("query_id", F.col("doc_id").alias("next"))
        facts = chosen.join(passages.select(F.col("doc_id").alias("next"), F.col("text").alias("body")), "next").join(queries, "query_id")
        facts = facts.select("query_id", "next", T.concise_fact(F.col("body"), F.col("text")).alias("fact"))
        state = keep(
            state.join(facts, "query_id", "left").select(
                "query_id", "text",
                F.when(F.col("next").isNull(), F.col("seen")).otherwise(F.array_append("seen", F.col("next"))).alias("seen"),
                F.when(F.col("next").isNull(), F.col("history")).otherwise(F.array_append("history", F.col("fact"))).alias("history"),
            )
        )
    return lists


def fuse_hops(lists: list[DataFrame], method: str = "mdr", depth: int = 100) -> DataFrame:
    return m3_fuse(*lists, depth=depth) if method == "m3" else rrf_fuse(*lists, depth=depth)


def extractive_reasoner(rows: DataFrame) -> DataFrame:
    """A stand-in for a generator: the evidence's two best sentences."""
    return rows.select("query_id", T.concise_fact(F.col("evidence"), F.col("text")).alias("line"))


def reasoning_prompt(question: Column, evidence: Column, reasoning: Column) -> Column:
    """The text that a generator gets."""
    so_far = F.when(reasoning != "", F.concat(F.lit(REASONING), reasoning)).otherwise(F.lit(""))
    return F.concat(F.lit(REASONING_HEAD), question, F.lit(REASONING_EVIDENCE), evidence, so_far, F.lit(REASONING_END))


def interleaved_reasoning(queries: DataFrame, retrieve: Retriever, passages: DataFrame, hops: int = 3, reasoner: Reasoner = extractive_reasoner, evidence: int = 4, depth: int = 100, keep: Callable[[DataFrame], DataFrame] = lambda df: df, fuse: Callable[..., DataFrame] = rrf_fuse) -> DataFrame:
    """Retrieve, reason one line over the best passages that were not shown before, and
    retrieve again with the question and that line; all lists are fused (by ``fuse``).
    ``passages(doc_id, title, text)``: a passage is shown as title and fact."""
    ranked = keep(retrieve(queries))
    lists = [ranked]
    none = F.array().cast(f"array<{passages.schema['doc_id'].dataType.simpleString()}>")
    state = queries.select("query_id", "text", none.alias("used"), F.lit("").alias("reasoning"))
    for _ in range(max(1, hops - 1)):
        top = ranked.where(F.col("rank") <= evidence).join(state.select("query_id", "text", "used"), "query_id").where(~F.array_contains("used", F.col("doc_id")))
        shown = top.join(passages.select("doc_id", "title", F.col("text").alias("body")), "doc_id")
        line = F.concat(T.text_or_empty(F.col("title")), F.lit(": "), T.concise_fact(F.col("body"), F.col("text")))
        in_order = F.array_sort(F.collect_list(F.struct("rank", "doc_id", line.alias("line"))))
        seen = shown.groupBy("query_id").agg(in_order.alias("s")).select("query_id", F.transform("s", lambda x: x["doc_id"]).alias("new"), F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("evidence"))
        asked = state.join(seen, "query_id", "left").withColumn("evidence", T.text_or_empty(F.col("evidence")))
        asked = keep(asked.withColumn("prompt", reasoning_prompt(F.col("text"), F.col("evidence"), F.col("reasoning"))))
        lines = reasoner(asked.select("query_id", "text", "evidence", "prompt")).select("query_id", F.get(F.split(F.trim("line"), "\n"), F.lit(0)).alias("line"))
        state = keep(asked.join(lines, "query_id", "left").select("query_id", "text", F.concat("used", F.coalesce("new", none)).alias("used"), T.text_or_empty(F.col("line")).alias("reasoning")))
        ranked = keep(retrieve(state.select("query_id", F.concat("text", F.lit(" "), "reasoning").alias("text"))))
        lists.append(ranked)
    return fuse(*lists, depth=depth)
