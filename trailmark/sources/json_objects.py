"""Entries of JSON files that are one object each, cut in parallel.

Spark's text reader splits a file of any size at a separator.  With the comma as that
separator a block begins behind a comma, hence never within an escape, and what it holds
depends on two things only: whether it begins inside a string, and how deep.  The first
pass gives, for both beginnings of a block, how far it changes them; running sums over
the blocks of a file, a row for each, tell how every block begins.  The second pass cuts
each block at the commas of depth one.  An entry that spans blocks is put together from
its pieces, at most two of a block.

All blocks are read a third time for these pieces.  An entry, with the batch it stands in, is
the unit of memory, not a file.  An empty file has no entries.  Files that are no single object, or hold an entry that is no JSON, fail with
their name and the place of the block.  An empty object has no entries; each entry of a
repeated key gives a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

_SPACE = b" \t\r\n"
_MARK = b"\xef\xbb\xbf"
_STEPS = np.zeros(256, np.int64)
_STEPS[[ord("{"), ord("[")]] = 1
_STEPS[[ord("}"), ord("]")]] = -1


def _strings(data: np.ndarray, inside: bool) -> np.ndarray:
    """Of each byte whether it stands within a string."""
    quotes = data == ord('"')
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):
        first = np.flatnonzero(np.append(True, np.diff(slashes) > 1))
        length = np.diff(np.append(first, len(slashes)))
        behind = slashes[first] + length
        quotes[behind[(length % 2 == 1) & (behind < len(data))]] = False
    return (np.cumsum(quotes) + inside) % 2 == 1


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, first row, text) of each block's rows in a batch (file, block, value, ..)."""
    files, blocks = batch.column(0), batch.column(1).to_numpy()
    names = files.dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero(np.append(True, (np.diff(blocks) != 0) | (np.diff(names) != 0))) if len(blocks) else []
    for start, stop in zip(edges, [*edges[1:], len(blocks)]):
        yield files[int(start)].as_py(), int(blocks[start]), int(start), b",".join(batch.column(2).slice(start, stop - start).to_pylist())


def _changes(batches):
    """(file, block, parity, outer, inner): whether a block leaves the kind of place it began
    in, and its change of depth if it begins outside a string, or inside one."""
    here, row = None, [0, 0, 0]

    def out():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*here, *row)], names=["file", "block", "parity", "outer", "inner"])

    for batch in batches:
        for file, block, _, text in _blocks(batch):
            if here != (file, block):
                if here:
                    yield out()
                here, row = (file, block), [0, 0, 0]
            data = np.frombuffer(text, np.uint8)
            within = _strings(data, False)
            steps = _STEPS[data]
            outer, inner = int(steps[~within].sum()), int(steps[within].sum())
            row[1], row[2] = (row[1] + inner, row[2] + outer) if row[0] else (row[1] + outer, row[2] + inner)
            row[0] ^= int(within[-1]) if len(within) else 0
    if here:
        yield out()


class _Cutter:
    """Cuts one block, a batch at a time; ``rows`` gets (file, block, n, text, begins, ends)."""

    def __init__(self, file: str, block: int, inside: bool, depth: int) -> None:
        self.file, self.block, self.inside, self.depth = file, block, inside, depth
        self.outer = depth == 0
        self.begins = depth == 1 and not inside  # behind a comma between entries
        self.opened, self.fresh, self.n, self.pending, self.rows = block > 0, True, 0, [], []

    def fail(self, why: str):
        raise ValueError(f"{self.file}, block at byte {self.block}: {why}")

    def emit(self, ends: bool, empty: bool = False) -> None:
        text, self.pending = b"".join(self.pending), []
        if not (empty and not text.strip(_SPACE)):
            if self.begins and not text.strip(_SPACE):
                self.fail("an entry is missing")
            self.rows.append((self.file, self.block, self.n, text, self.begins, ends))
            self.n += 1
        self.begins = True

    def blank(self) -> None:
        text = b"".join(self.pending)
        if (text if self.opened else text.removeprefix(_MARK)).strip(_SPACE):
            self.fail("the file is not one JSON object")
        self.pending = []

    def add(self, text: bytes) -> None:
        text, self.fresh = (text if self.fresh else b"," + text), False  # the comma between two batches
        data = np.frombuffer(text, np.uint8)
        within = _strings(data, self.inside)
        steps = np.where(within, 0, _STEPS[data])
        depth = self.depth + np.cumsum(steps)
        commas = (data == ord(",")) & ~within & (depth == 1)
        events = np.flatnonzero(commas | ((steps == 1) & (depth == 1)) | ((steps == -1) & (depth == 0)))
        last, just = 0, False
        for at in events.tolist():
            self.pending.append(text[last:at])
            last = at + 1
            if text[at] == ord(","):
                self.emit(True)
                just = False
            elif steps[at] == 1:
                self.blank()
                if self.opened or text[at] != ord("{"):
                    self.fail("the file is not one JSON object")
                self.opened, self.outer, self.begins, just = True, False, True, True
            else:
                self.emit(True, empty=just)
                self.outer = True
        self.pending.append(text[last:])
        if len(data):
            self.inside, self.depth = bool(within[-1]), int(depth[-1])

    def end(self) -> list[tuple]:
        if self.outer:
            self.blank()
        else:
            self.emit(self.depth == 1 and not self.inside)
        return self.rows


PIECE = "file string, block long, n long, text binary, begins boolean, ends boolean"


def _cut(whole: bool):
    """Entries that stand within a block, or the pieces of the others."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]
    names = ["file", "block", "n", "text", "begins", "ends"]

    def cut(batches):
        cutter = None
        for batch in batches:
            done = []
            for file, block, row, text in _blocks(batch):
                if cutter is None or (cutter.file, cutter.block) != (file, block):
                    done += cutter.end() if cutter else []
                    cutter = _Cutter(file, block, batch.column(3)[row].as_py(), batch.column(4)[row].as_py())
                cutter.add(text)
            if cutter:
                done, cutter.rows = done + cutter.rows, []
            yield from table(done)
        yield from table(cutter.end() if cutter else [])

    def table(rows):
        rows = [r for r in rows if (r[4] and r[5]) == whole]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return cut


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, text): every entry, ``"key": value``, of the files' objects."""
    ship(spark)
    lines = spark.read.option("lineSep", ",").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    changes = lines.mapInArrow(_changes, "file string, block long, parity long, outer long, inner long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    states = changes.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
    states = states.withColumn("step", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")))
    states = states.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    whole = (F.sum("parity").over(every) % 2 == 0) & (F.sum("step").over(every) == 0)
    states = states.withColumn("whole", whole)
    broken = F.raise_error(F.concat("file", F.lit(": a string or a bracket of the JSON object is not closed")))
    states = states.select("file", "block", "inside", F.when(F.col("whole"), F.col("depth")).otherwise(broken.cast("long")).alias("depth"))
    placed = lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", "value", "inside", "depth")  # a row for each block
    entries = placed.mapInArrow(_cut(True), PIECE).select("file", "block", "text")
    pieces = placed.mapInArrow(_cut(False), PIECE)
    order = Window.partitionBy("file").orderBy("block", "n")
    numbered = pieces.withColumn("entry", F.sum(F.col("begins").cast("long")).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "n", F.col("text").cast("string").alias("text")))), lambda p: p["text"])
    joined = numbered.groupBy("file", "entry").agg(F.min("block").alias("block"), F.array_join(parts, ",").cast("binary").alias("text"))
    every_ = entries.unionByName(joined.select("file", "block", "text"))
    return every_.withColumn("text", F.col("text").cast("string"))


def read_object_file(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON file that is one object: (file, key, value) per entry.  ``value_schema``: the
    object as a map; entries of other types fail."""
    entries = read_entries(spark, path).withColumn("text", F.concat(F.lit("{"), "text", F.lit("}")))
    place = F.concat("file", F.lit(", block at byte "), F.col("block").cast("string"), F.lit(": not JSON: "), F.substring("text", 1, 80))
    valid = F.when(F.json_object_keys("text").isNull(), F.raise_error(place).cast("string")).otherwise(F.col("text"))
    return entries.select("file", F.explode(F.from_json(valid, value_schema, {"mode": "FAILFAST"})).alias("key", "value"))
