"""Substring dedup with a log-structured fingerprint index.

A window is ``width`` consecutive words of one document.  Every window is owned
by its smallest gram of ``gram`` words (see ``common.minimisers``), so equal
windows have equal owners at equal places, and the owners' hashes are the
fingerprints that the index holds: about two per ``width - gram + 2`` words.

The index is a log of sorted immutable runs.  A run has a row for every different
stretch (an owner with the windows around it) of its documents: fingerprint, a
128-bit hash of the stretch's words, the smallest document.  A batch of documents is
fingerprinted into a new run, which is merge-joined with the history; then runs of
like size are compacted into one.  Batches come in order of document id, so history
is what has a smaller id; within a batch the smallest id counts.

What the join finds is verified.  A stretch that an earlier document holds whole goes
by its hash.  Where an owner has different stretches, their windows are compared by
hashes of 128 bits of their own; of the history only the documents that first hold
stretches of such owners are compared again, so a batch moves what it has in common with
the history, and a passage in a third of all documents is a few rows.  The scan for them
asks for at most ``SPANS`` ranges of ids that hold them all: of a table in order of its ids
only the row groups of these ranges are read, of another one all.  The first
holders' windows are compared in the task of the owner, or, if more than ``most``
stretches share an owner, by partial minima over the windows.

``save`` and ``load`` keep an index between sessions; its runs are files already.

Words are ``[^\\x20\\x09-\\x0D]+`` unchanged.  Defined results: a null or empty
text, or one shorter than a window, keeps all its words; windows are judged on
the input; rows that share an id count as one document, so they never remove
from each other; rows without an id are kept whole and remove nothing; an empty
table gives an empty result.  Ids that are no whole numbers are numbered in their order
first; an id column named like a result keeps its name, and the result gets a trailing
underscore.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    trimmed, WordHashes, binary_buffer, bits_for, gram_hashes, in_filter, key_bits, key_filter, materialize, minimisers, mix, new_path, numbered, prefix_sums, range_hash, renamed, row_key, slices, split_by_bits,
    text_buffer, whole_groups, with_id, word_parts, word_streams,
)

WIDTH = 50
GRAM = 25
SPANS = 64
_SECOND = np.uint64(0xD1342543DE82EF95)
_SECOND_INV = np.uint64(pow(int(_SECOND), -1, 1 << 64))


class _Owners:
    """The owners of some texts' windows and hashes of any runs of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: WordHashes, width: int, gram: int) -> None:
        first, second, self.at = word_streams(data, offsets, hashes, lower=False)
        self.sums, self.more = prefix_sums(first), prefix_sums(second, _SECOND_INV)
        self.grams = mix(gram_hashes(self.sums, gram))
        self.owner, self.lo, self.hi, self.row = minimisers(self.grams, self.at, gram, width)

    def only(self, hit: np.ndarray) -> None:
        self.owner, self.lo, self.hi, self.row = self.owner[hit], self.lo[hit], self.hi[hit], self.row[hit]

    @property
    def h(self) -> np.ndarray:
        return self.grams[self.owner]

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits over the words from start to stop."""
        n = (stop - start).astype(np.uint64)
        return mix(range_hash(self.sums, start, stop) + n).view(np.int64), mix(range_hash(self.more, start, stop, _SECOND) + n).view(np.int64)


def fingerprints(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``docs(id, text)`` to (h, s1, s2, id): the stretches of the documents."""

    def scan(batches):
        hashes = WordHashes()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                o = _Owners(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hashes, width, gram)
                s1, s2 = o.hashes(o.lo, o.hi + width)
                ids = batch.column(0).slice(a, b - a).take(pa.array(o.row))
                yield pa.RecordBatch.from_arrays([pa.array(o.h.view(np.int64)), pa.array(s1), pa.array(s2), ids], names=["h", "s1", "s2", "id"])

    return docs.select("id", "text").mapInArrow(trimmed(scan), "h long, s1 long, s2 long, id long")


def stretches(docs: DataFrame, filter_: np.ndarray, width: int, gram: int) -> DataFrame:
    """(h, s1, s2, id, row, first, n, windows): owners that pass the filter, the hash of
    the stretch, the place and number of its windows, and their hashes."""

    def scan(batches):
        hashes = WordHashes()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                o = _Owners(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hashes, width, gram)
                o.only(in_filter(filter_, o.h))
                s1, s2 = o.hashes(o.lo, o.hi + width)
                n = o.hi - o.lo + 1
                start = np.repeat(o.lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                windows = np.stack(o.hashes(start, start + width), axis=1)
                edges = np.concatenate([[0], np.cumsum(n * 16)]).astype(np.int32)
                rows = pa.array(o.row)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(windows.tobytes())])
                ids, keys = (batch.column(c).slice(a, b - a).take(rows) for c in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o.h.view(np.int64)), pa.array(s1), pa.array(s2), ids, keys, pa.array(o.lo - o.at[o.row]), pa.array(n), packed], names=["h", "s1", "s2", "id", "row", "first", "n", "windows"]
                )

    return docs.select("id", "text", "row").mapInArrow(trimmed(scan), "h long, s1 long, s2 long, id long, row binary, first long, n long, windows binary")


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of stretches (h, id, row, first, n, windows) every window: its hashes
    (windows, 2), its stretch and its place in the document."""
    first, n = np.asarray(batch.column(3)), np.asarray(batch.column(4))
    windows = binary_buffer(batch.column(5))[0].view(np.int64).reshape(-1, 2)
    which = np.repeat(np.arange(len(n)), n)
    return windows, which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _later(batches):
    """Windows that a smaller id holds, within whole groups of owners: (row, first, n)."""
    for batch in whole_groups(batches):
        h, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        windows, which, place = _flat(batch)
        group = np.cumsum(np.append(0, h[1:] != h[:-1]))[which]
        order = np.lexsort((ids[which], windows[:, 1], windows[:, 0], group))
        w, g, i = windows[order], group[order], ids[which][order]
        start = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(axis=1) | (g[1:] != g[:-1])))
        least = np.repeat(i[start], np.diff(np.append(start, len(order))))
        hit = np.sort(order[i > least])
        which, place = which[hit], place[hit]
        begin = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1))) if len(hit) else hit
        yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(which[begin])), pa.array(place[begin]), pa.array(np.diff(np.append(begin, len(hit))))], names=["row", "first", "n"])


def _unpacked(batches):
    """Stretches to their windows: (h, w1, w2, id, row, place)."""
    for batch in batches:
        windows, which, place = _flat(batch)
        take = pa.array(which)
        columns = [batch.column(0).take(take), pa.array(windows[:, 0].copy()), pa.array(windows[:, 1].copy()), batch.column(1).take(take), batch.column(2).take(take), pa.array(place)]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "w1", "w2", "id", "row", "place"])


def _in_spans(ids: DataFrame, low: int | None, high: int | None) -> Column:
    """A condition on ``id`` that a scan can push down: at most ``SPANS`` ranges that hold
    all of ``ids``, which lie between ``low`` and ``high``."""
    if low is None:
        return F.lit(False)
    width = -(-(high - low + 1) // SPANS)
    slot = F.floor((F.col("id").cast("decimal(20)") - F.lit(low)) / F.lit(width).cast("decimal(20)"))
    spans = ids.groupBy(slot.alias("slot")).agg(F.min("id"), F.max("id")).collect()  # SPANS rows at most
    return reduce(Column.__or__, [F.col("id").between(a, b) for _, a, b in spans])


SAME = ["h", "s1", "s2"]
RUN = "h long, s1 long, s2 long, least long"


class FingerprintIndex:
    """The log of runs.  ``add`` takes batches whose ids are larger than all before
    and returns the word ranges to remove.  history: the texts of the documents that
    the index holds already, if it was loaded."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM, fanout: int = 2, most: int = 4_000, history: DataFrame | None = None) -> None:
        self.width, self.gram, self.fanout, self.most = width, gram, fanout, most
        self.runs: list[tuple[int, str, DataFrame]] = []  # (level, path, run), newest last
        self.documents = history

    def save(self, path: str) -> None:
        """Writes which runs there are; the runs stay where they are."""
        runs = [{"level": level, "path": place} for level, place, _ in self.runs]
        spark = self.runs[0][2].sparkSession if self.runs else SparkSession.active()
        line = json.dumps({"width": self.width, "gram": self.gram, "fanout": self.fanout, "most": self.most, "runs": runs})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, history: DataFrame) -> FingerprintIndex:
        """``history(id, row, text)``: the documents added so far."""
        held = json.loads(spark.read.text(path).first()[0])
        index = cls(held["width"], held["gram"], held["fanout"], held["most"], history)
        index.runs = [(r["level"], r["path"], spark.read.schema(RUN).parquet(r["path"])) for r in held["runs"]]
        return index

    def _run(self, rows: DataFrame, level: int) -> tuple[int, str, DataFrame]:
        """A sorted immutable run: ranges of fingerprints, in order."""
        path = new_path(rows.sparkSession, f"run-{level}")
        rows.sortWithinPartitions("h").write.option("compression", "zstd").parquet(path)
        return level, path, rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _compact(self) -> None:
        """Merges runs of like size; runs once they are read again, not before."""
        while len(self.runs) >= self.fanout and len({level for level, _, _ in self.runs[-self.fanout :]}) == 1:
            level, _, merged = self.runs[-self.fanout]
            for _, _, run in self.runs[-self.fanout + 1 :]:
                merged = merged.unionByName(run)
            self.runs[-self.fanout :] = [self._run(merged.groupBy(*SAME).agg(F.min("least").alias("least")), level + 1)]

    def add(self, docs: DataFrame) -> DataFrame:
        """``docs(id, row, text)`` to (row, first, n): ranges of removed words."""
        self._compact()
        batch = fingerprints(docs, self.width, self.gram).groupBy(*SAME).agg(F.min("id").alias("least"), F.max("id").alias("last"))
        level, path, batch = self._run(batch, 0)
        found = [batch.select(*SAME, "least", "last", F.lit(True).alias("new"))]
        for _, _, run in self.runs:
            before = run.join(batch.select("h").distinct(), "h", "left_semi")
            found.append(before.select(*SAME, "least", F.col("least").alias("last"), F.lit(False).alias("new")))
        every = found[0]
        for one in found[1:]:
            every = every.unionByName(one)
        # every stretch of the batch's owners: its first holder, and whether it begins in this batch
        firsts = every.groupBy(*SAME).agg(F.min("least").alias("least"), F.max("last").alias("last"), F.max("new").alias("new"), F.min("new").alias("fresh"))
        owners = firsts.groupBy("h").agg(F.count("*").alias("size"), F.max(F.col("least") < F.col("last")).alias("again"), F.max("fresh").alias("fresh"))
        # owners of repeated stretches; owners of different stretches, of which one at least is new, are open
        owners = materialize(owners.where("again or (fresh and size > 1)").withColumn("open", F.col("fresh") & (F.col("size") > 1)), "owners")
        firsts = materialize(firsts.join(owners.select("h", "open", "size"), "h"), "firsts")
        ranges = self._verify(docs, firsts, owners)
        self.documents = docs if self.documents is None else self.documents.unionByName(docs)
        self.runs.append((level, path, batch.select(*SAME, "least")))
        return ranges

    def holders(self, firsts: DataFrame) -> DataFrame | None:
        """The documents of the history that must be read again."""
        if self.documents is None:
            return None
        wanted = materialize(firsts.where("open and not fresh").select(F.col("least").alias("id")).distinct(), "history-holders")
        n, low, high = wanted.agg(F.count("*"), F.min("id"), F.max("id")).first()
        size = bits_for(n)
        bits = materialize(key_bits(wanted.select(F.xxhash64("id").alias("k")), "k", size), "history-bits")
        return split_by_bits(self.documents.where(_in_spans(wanted, low, high)), bits, "xxhash64(id)", True, size)

    def _verify(self, docs: DataFrame, firsts: DataFrame, owners: DataFrame) -> DataFrame:
        filter_ = key_filter(owners, "h", bits_for(owners.count()))
        found = materialize(stretches(docs, filter_, self.width, self.gram), "stretches")
        repeated = firsts.where("new and least < last").select(*SAME, "least")
        again = found.select(*SAME, "id", "row", "first", "n").join(repeated, SAME).where("id > least").select("row", "first", "n")
        # only first holders of open owners' stretches are compared window by window
        open_ = firsts.where("open").select(*SAME, F.col("least").alias("id"), "size", "fresh")
        columns = ["h", "id", "row", "first", "n", "windows"]
        held = found.join(open_.where("fresh"), [*SAME, "id"]).select(*columns, "size")
        past = self.holders(firsts)
        if past is not None:
            hot = owners.where("open").select("h")
            old = stretches(past, key_filter(hot, "h", bits_for(hot.count())), self.width, self.gram)
            held = held.unionByName(old.join(open_.where("not fresh"), [*SAME, "id"]).select(*columns, "size"))
        held = materialize(held, "held")
        normal = held.where(F.col("size") <= self.most).select(columns).repartition("h").sortWithinPartitions("h")
        compared = normal.mapInArrow(trimmed(_later), "row binary, first long, n long")
        windows = held.where(F.col("size") > self.most).select(columns).mapInArrow(trimmed(_unpacked), "h long, w1 long, w2 long, id long, row binary, place long")
        same = ["h", "w1", "w2"]
        earliest = windows.groupBy(*same).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(*same, "least")
        counted = windows.join(earliest, same).where("id > least").select("row", F.col("place").alias("first"), F.lit(1).cast("long").alias("n"))
        # rows of the history come again, as they came in their own batch; sets take no notice
        return again.unionByName(compared).unionByName(counted)


def remove_ranges(docs: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """``docs(id, row, text)`` and window starts (row, first, n) to (id, n_words,
    n_removed, kept_sha256, kept): the words left, joined by one space."""
    packed = materialize(ranges.groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("cut")), "cuts")
    size = bits_for(packed.count())
    hit = materialize(key_bits(packed, "xxhash64(row)", size), "cut-bits")
    source = docs.select("id", "text", "row")
    joined = split_by_bits(source, hit, "xxhash64(row)", True, size).join(packed, "row", "left").select("id", "text", "cut")
    whole = split_by_bits(source, hit, "xxhash64(row)", False, size).select("id", "text", F.lit(None).cast(packed.schema["cut"].dataType).alias("cut"))

    def cut(batches):
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            data, offsets = text_buffer(batch.column(1))
            for i, ranges_ in enumerate(batch.column(2)):
                steps: dict[int, int] = {}
                for r in ranges_.as_py() or ():
                    for place, change in ((r["first"], 1), (r["first"] + r["n"] - 1 + width, -1)):
                        steps[place] = steps.get(place, 0) + change
                where = np.array(sorted(steps), np.int64)
                depth = np.cumsum([0, *(steps[x] for x in where.tolist())])
                total, removed, out = 0, 0, []
                for part in word_parts(data[offsets[i] : offsets[i + 1]].tobytes()):
                    words = part.split()
                    gone = depth[np.searchsorted(where, np.arange(total, total + len(words)), "right")] > 0
                    total += len(words)
                    left = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                    if left:
                        out.append(b" ".join(left))
                    removed += int(gone.sum())
                left = b" ".join(out)
                n_words.append(total)
                n_removed.append(removed)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = "id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return joined.mapInArrow(trimmed(cut), kind).unionByName(whole.mapInArrow(trimmed(cut), kind))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = 3) -> DataFrame:
    """All of a table through the index, in ``batches`` ranges of ids: (id, n_words,
    n_removed, kept_sha256, kept).  The third batch meets a compacted run."""
    docs, names = numbered(docs.select(id_col, text_col), id_col)
    source = docs.select(F.col("__tm_id").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    known = source.where("id is not null")
    bounds = known.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(b) for b in bounds}), None]
    index = FingerprintIndex(width, gram)
    ranges = None
    for low, high in zip(edges, edges[1:]):
        part = known
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        found = materialize(index.add(part), "ranges")
        ranges = found if ranges is None else ranges.unionByName(found)
    return with_id(renamed(remove_ranges(source, ranges, width), names, ("id",)), id_col)
