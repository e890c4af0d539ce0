"""What models read: tokenised passages with word positions and span labels, and padded
batches of like length for sequence models.

A tokenizer is a file of the ``tokenizers`` library, named by a path that every
executor can open; it is loaded once in a worker.  Special tokens are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lexical import row_slices

_WORDS = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]")
#: Characters that are tokenised at a time: what a tokenizer returns takes some hundred bytes
#: a token, so a batch goes through it in slices.
MOST_CHARS = 1 << 18
#: What a label is where a batch is padded, which losses leave out.
IGNORED = -100


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: Column, path: str) -> Column:
    """(ids, starts, ends) of a text's subwords, as character offsets; null is empty."""

    @F.pandas_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        texts, rows = [x or "" for x in texts], []
        for start, stop in row_slices(np.array([len(x) for x in texts], np.int64), MOST_CHARS):
            found = _tokenizer(path).encode_batch(texts[start:stop], add_special_tokens=False)
            rows += [(np.array(e.ids, np.int32), *np.array(e.offsets, np.int32).reshape(-1, 2).T) for e in found]
        return pd.DataFrame(rows, columns=["ids", "starts", "ends"])

    return run(text)


def _parts(batch: pa.RecordBatch, *texts: str):
    """Slices of a batch whose texts have ``MOST_CHARS`` characters, or one row."""
    sizes = sum(np.asarray(pc.utf8_length(batch.column(batch.schema.get_field_index(c))), np.int64) for c in texts)
    for start, stop in row_slices(sizes, MOST_CHARS):
        yield batch.slice(start, stop - start)


def align(words: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> list[list[int]]:
    """For each word the places of the subwords that overlap it, both in order of the
    text; two pointers, so linear in their number and in the overlaps."""
    out: list[list[int]] = []
    low = 0
    for start, end in words:
        while low < len(offsets) and offsets[low][1] <= start:
            low += 1
        at, hits = low, []
        while at < len(offsets) and offsets[at][0] < end:
            if offsets[at][1] > start:
                hits.append(at)
            at += 1
        out.append(hits)
    return out


@dataclass(frozen=True)
class Layout:
    """The tokens before the question, between question and passage, and behind it, and the
    longest input."""

    before: tuple[int, ...] = ()
    between: tuple[int, ...] = ()
    after: tuple[int, ...] = ()
    longest: int = 512


def span_inputs(examples: DataFrame, path: str, layout: Layout = Layout(), most: int = 6) -> DataFrame:
    """``examples(query_id, question, flat_tokens, passages, start_position, end_position)``,
    passages being structs with global_start, global_end and is_answer_passage, to one
    row for each of the first ``most`` passages: (query_id, passage, input_ids,
    positions, is_answer_passage, start, end, mapped).

    Question and passage are cut to the longest input at the passage's end only; a
    question that leaves no room fails.  ``positions`` holds each subword's word, counted
    over the whole example (of several the last), or -1; ``start`` and ``end`` the label's
    first and last subword, in the passages that hold its words, else null; ``mapped``
    whether the example's label was found."""
    p = F.posexplode(F.slice("passages", 1, most))
    rows = examples.select("query_id", "question", "flat_tokens", "start_position", "end_position", p.alias("passage", "p"))
    words = F.slice("flat_tokens", (F.col("p.global_start") + 1).cast("int"), (F.col("p.global_end") - F.col("p.global_start") + 1).cast("int"))
    rows = rows.select(
        "query_id", "passage", T.text_or_empty(F.col("question")).alias("question"), T.detokenize(words).alias("text"), F.col("p.global_start").cast("long").alias("first"),
        F.col("start_position").cast("long").alias("s"), F.col("end_position").cast("long").alias("e"), F.col("p.is_answer_passage").alias("is_answer_passage"),
    )
    kind = f"query_id {rows.schema['query_id'].dataType.simpleString()}, passage int, input_ids array<int>, positions array<long>, is_answer_passage boolean, start int, end int"

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole, "question", "text")):
            columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            tool = _tokenizer(path)
            asked = tool.encode_batch(columns["question"], add_special_tokens=False)
            read = tool.encode_batch(columns["text"], add_special_tokens=False)
            ids, positions, starts, ends = [], [], [], []
            for i, (q, t) in enumerate(zip(asked, read)):
                head = [*layout.before, *q.ids, *layout.between]
                room = layout.longest - len(head) - len(layout.after)
                if room < 1:
                    raise ValueError(f"the question of {columns['query_id'][i]} leaves no room for a passage")
                kept, offsets = t.ids[:room], t.offsets[:room]
                place, start, end = [-1] * len(kept), None, None
                spans = [m.span() for m in _WORDS.finditer(columns["text"][i])]
                for word, hits in enumerate(align(spans, offsets)):
                    number = columns["first"][i] + word
                    for h in hits:
                        place[h] = number
                    if hits and number == columns["s"][i]:
                        start = len(head) + hits[0]
                    if hits and number == columns["e"][i]:
                        end = len(head) + hits[-1]
                ids.append([*head, *kept, *layout.after])
                positions.append([-1] * len(head) + place + [-1] * len(layout.after))
                starts.append(start)
                ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(positions, pa.list_(pa.int64())), batch.column(batch.schema.get_field_index("is_answer_passage")),
                 pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["query_id", "passage", "input_ids", "positions", "is_answer_passage", "start", "end"],
            )

    made = rows.mapInArrow(run, kind)
    of = Window.partitionBy("query_id")
    return made.withColumn("mapped", F.max(F.col("start").isNotNull()).over(of) & F.max(F.col("end").isNotNull()).over(of))


def require_mapped(inputs: DataFrame) -> None:
    """Raises if an example's label is not among its subwords, as after a cut."""
    lost = [r[0] for r in inputs.where("not mapped").select("query_id").distinct().limit(5).collect()]
    if lost:
        raise ValueError(f"labels beyond what was kept of their passages: {lost}")


# ------------------------------------------------------------------- sequence models


def sequence_batches(pairs: DataFrame, path: str, size: int = 8, most_source: int = 1024, most_target: int = 256, pad: int = 0, end: int | None = None, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``pairs(id, source, target)`` as padded batches of ``size`` examples of like length:
    (batch, ids, input_ids, attention_mask, labels), every example once.  Sources and
    targets are cut to their longest, ``end`` included where there is one; labels are
    ``IGNORED`` where they are padded.  Examples are range-partitioned by length, ties in
    the order of a seeded hash; a range's last batch may be smaller.  ``batch`` numbers
    batches in a seeded order that mixes lengths; it changes with the epoch."""
    tail = [] if end is None else [end]
    cut = lambda ids, most: F.concat(F.slice(ids, 1, most - len(tail)), F.array(*map(F.lit, tail)).cast("array<int>"))
    rows = pairs.select("id", cut(encode(F.col("source"), path)["ids"], most_source).alias("a"), cut(encode(F.col("target"), path)["ids"], most_target).alias("b"))
    order = ["n", "m", "h", "id"]
    dealt = rows.select("id", "a", "b", F.size("a").alias("n"), F.size("b").alias("m"), F.xxhash64("id", F.lit(seed + epoch)).alias("h")).repartitionByRange(*order).sortWithinPartitions(*order)
    id_kind = pairs.schema["id"].dataType.simpleString()
    lists = "array<array<int>>"

    def run(batches):
        held: list[tuple] = []

        def made(group: list[tuple]) -> dict:
            n, m = max(len(a) for _, a, _ in group), max(len(b) for _, _, b in group)
            return {
                "ids": [i for i, _, _ in group], "input_ids": [a + [pad] * (n - len(a)) for _, a, _ in group], "attention_mask": [[1] * len(a) + [0] * (n - len(a)) for _, a, _ in group],
                "labels": [b + [IGNORED] * (m - len(b)) for _, _, b in group],
            }

        def out(groups: list[list[tuple]], kind) -> pa.RecordBatch:
            three = pa.list_(pa.list_(pa.int32()))
            schema = pa.schema([("ids", pa.list_(kind)), ("input_ids", three), ("attention_mask", three), ("labels", three)])
            return pa.RecordBatch.from_pylist([made(g) for g in groups], schema)

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            held += zip(*(batch.column(i).to_pylist() for i in range(3)))
            full = len(held) // size * size
            if full:
                yield out([held[i : i + size] for i in range(0, full, size)], kind)
                held = held[full:]
        if held:
            yield out([held], kind)

    found = dealt.select("id", "a", "b").mapInArrow(run, f"ids array<{id_kind}>, input_ids {lists}, attention_mask {lists}, labels {lists}")
    return found.withColumn("batch", F.xxhash64("ids", F.lit(seed + epoch)))


def padding_share(batches: DataFrame) -> DataFrame:
    """One row: the share of input tokens that are padding."""
    real = F.aggregate(F.flatten("attention_mask"), F.lit(0), lambda s, x: s + x)
    return batches.agg((1 - F.sum(real) / F.sum(F.size(F.flatten("attention_mask")))).alias("padding"))
