"""Best-fit packing of documents into fixed-length token sequences.

A document is its token ids and an end id; one longer than a sequence is cut
into whole-sequence pieces, the first of which may be shorter.  What remains is
one-dimensional bin packing over the histogram of piece lengths, which has at
most ``length`` entries however many documents there are.  Its configuration
linear program is solved on the driver by multiplicative weights: each round
prices lengths, finds the best-paying configuration by the unbounded-knapsack
dynamic program, uses it as often as its scarcest length allows, and lowers the
price of what is covered.  The averaged solution is rounded down, and best fit
by decreasing length packs what rounding left over.

The plan (configurations and their counts) is bounded by rounds and lengths.
Pieces find their place by their rank among those of equal length; ranks come
from counts by task, so no length, however common, meets in one task.

Defined results: a null or empty text is one piece, the end id alone; repeated
rows are packed each; an empty table gives an empty plan.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, trimmed

# ------------------------------------------------------------------- tokenising


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.  The merges run
    in tiktoken over the same vocabulary, which gives the same ids several times
    as fast.  To ``tokenizers`` itself go texts with the control characters that the
    two pattern engines class differently, texts with white space longer than
    ``RUN`` (tiktoken's pattern engine recurses over it and gives up at some hundred
    thousand) and texts with the file's added tokens, which are ids of their own,
    where there are several or any that take in what stands beside them.

    A long text is encoded in parts, cut where an ASCII letter or digit is followed
    by a space or a line end: there the pattern ends a piece whatever follows, so
    the parts' ids are those of the whole, and memory follows the part."""

    RUN, PART = 10_000, 1 << 20
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    odd = re.compile("[\x1c-\x1f\x85᠎​-‏ - ⁠﻿]")
    space = re.compile(r"\s+")
    seam = re.compile(r"[A-Za-z0-9](?=[ \n])")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        letters = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
        others = [b for b in range(256) if b not in letters]
        byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
        tokens = self.exact.get_added_tokens_decoder()
        added = {t.content: i for i, t in tokens.items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.exact.get_vocab(False).items() if token not in added}
        alone = len(added) < 2 and not any(t.lstrip or t.rstrip or t.single_word for t in tokens.values())
        if not alone:
            self.odd = re.compile("|".join([self.odd.pattern, *map(re.escape, added)]))
        self.parted = alone and not any(self.space.search(t) for t in added)  # no added token reaches over a cut

        class Merges(tiktoken.Encoding):
            def encode_ordinary(self, text: str) -> list[int]:  # of a text as tokenizers reads it, added tokens included
                return self.encode(text, allowed_special="all")

        self.fast = Merges("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=added)

    def _long_space(self, text: str) -> bool:
        return len(text) > self.RUN and any(m.end() - m.start() > self.RUN for m in self.space.finditer(text))

    def __call__(self, text: str) -> list[int]:
        if self.odd.search(text) or self._long_space(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str, end_id: int) -> np.ndarray:
        """The ids and the end id."""
        parts, start = [], 0
        while self.parted and len(text) - start > 2 * self.PART:
            seam = self.seam.search(text, start + self.PART)
            if not seam:
                break
            parts.append(np.array(self(text[start : seam.end()]), "<u4"))
            start = seam.end()
        parts.append(np.array([*self(text[start:] if start else text), end_id], "<u4"))
        return np.concatenate(parts)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth): a row per piece, with the
    task that made it and its rank among that task's pieces of its length."""
    source = docs.select(id_col, text_col)
    kind = T.StructType([source.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "task", "nth"))])

    def cut(batches):
        from pyspark import TaskContext

        encode, task = Encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            row, piece, start, size, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode.array(text.as_py() or "", end_id)
                raw, n = ids.tobytes(), len(ids)
                first = n % length or length
                edges = [0, *range(first, n + 1, length)]
                for k in range(len(edges) - 1):
                    a, b = edges[k], edges[k + 1]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    nth.append(int(seen[b - a]))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc)), pa.array([task] * len(row), pa.int64()), pa.array(nth, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return source.mapInArrow(trimmed(cut), kind)


# --------------------------------------------------------------------- planning


def _knapsack(price: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the highest total price: {length: times}."""
    sizes = np.flatnonzero(price > 0)
    if not len(sizes):
        return {}
    value = price[sizes]
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))
        if n:
            total = best[c - sizes[:n]] + value[:n]
            i = int(total.argmax())
            best[c], took[c] = total[i], sizes[i]
    out: dict[int, int] = {}
    c = int(best.argmax())
    while c and took[c]:
        out[int(took[c])] = out.get(int(took[c]), 0) + 1
        c -= int(took[c])
    return out


def solve(counts: np.ndarray, capacity: int, rounds: int = 400, epsilon: float = 0.1) -> list[tuple[dict[int, int], float]]:
    """A fractional solution of the configuration LP: configurations and how often
    each is used.  Every length is covered at most ``counts`` times."""
    need = counts.astype(float)
    have = np.flatnonzero(need > 0)
    if not len(have):
        return []
    price = np.zeros(capacity + 1)
    price[have] = have / capacity
    used: dict[tuple, float] = {}
    cover = np.zeros(capacity + 1)
    for _ in range(rounds):
        config = _knapsack(price, capacity)
        if not config:
            break
        sizes = np.array(list(config))
        times = np.array(list(config.values()))
        step = (need[sizes] / times).min()
        key = tuple(sorted(config.items(), reverse=True))
        used[key] = used.get(key, 0.0) + step
        cover[sizes] += step * times
        price[sizes] *= np.exp(-epsilon * step * times / need[sizes])
    scale = (cover[have] / need[have]).max()  # in proportion, so that no length is used beyond its count
    return [(dict(c), x / scale) for c, x in used.items()]


def plan(counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Whole sequences: (lengths in order, how many such sequences).  All pieces
    are placed exactly once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    while True:
        before = int(left.sum())
        for config, times in sorted(solve(left, capacity, rounds), key=lambda x: -x[1]):
            times = min([int(times + 1e-9), *(int(left[s]) // n for s, n in config.items())])
            # a configuration is used as it is only if it is nearly full
            if times and sum(s * n for s, n in config.items()) >= capacity * 0.98:
                out.append((tuple(s for s, n in config.items() for _ in range(n)), times))
                for s, n in config.items():
                    left[s] -= n * times
        if left.sum() >= 0.9 * before:
            break
    bins: dict[tuple[int, ...], int] = {}
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # open sequences by free space
    free = 0  # a bit for each free space of which there is one
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n and (fits := free >> size):  # the tightest that fits
            room = size + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            content, many = stack.pop()
            took = min(n, many)
            if took < many:
                stack.append([content, many - took])
            if not stack:
                free &= ~(1 << room)
            rooms[room - size].append([content + [size], took])
            if room > size:
                free |= 1 << (room - size)
            n -= took
        if n:
            each = capacity // size
            if n // each:
                rooms[capacity - each * size].append([[size] * each, n // each])
                if capacity - each * size:
                    free |= 1 << (capacity - each * size)
            if n % each:
                rooms[capacity - n % each * size].append([[size] * (n % each), 1])
                free |= 1 << (capacity - n % each * size)
    for stack in rooms:
        for content, many in stack:
            bins[tuple(content)] = bins.get(tuple(content), 0) + many
    return out + list(bins.items())


class Places:
    """From a length and a rank among the pieces of that length to a place."""

    def __init__(self, sequences: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}
        filled: dict[int, int] = {}
        base = 0
        for content, many in sequences:
            at: dict[int, list[int]] = {}
            offset = 0
            for size in content:
                at.setdefault(size, []).append(offset)
                offset += size
            for size, offsets in at.items():
                runs.setdefault(size, []).append((filled.get(size, 0), base, len(offsets), offsets[0]))
                filled[size] = filled.get(size, 0) + many * len(offsets)
                if any(o != offsets[0] + i * size for i, o in enumerate(offsets)):
                    raise ValueError("equal lengths of a sequence must be neighbours")
            base += many
        self.runs = {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in runs.items()}

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size).tolist():
            mine = np.flatnonzero(size == s)
            first, base, each, at = self.runs[s]
            i = np.searchsorted(first, rank[mine], "right") - 1
            past = rank[mine] - first[i]
            sequence[mine] = base[i] + past // each[i]
            offset[mine] = at[i] + past % each[i] * s
        return sequence, offset


# --------------------------------------------------------------------- operator


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2, rounds: int = 400) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece."""
    pieces = materialize(token_pieces(docs, tokenizer, id_col, text_col, length, end_id), "pieces")
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(length + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``length`` rows
        histogram[row["length"]] = row["n"]
    places = Places(plan(histogram, length, rounds))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        for batch in batches:
            sequence, offset = places.of(np.asarray(batch.column(3)), np.asarray(batch.column(5)))
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(trimmed(place), kind)
