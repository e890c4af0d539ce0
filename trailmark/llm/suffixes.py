"""Suffix-array dedup: hash-compared suffix sort over the repeated parts.

Bytes covered by a ``width``-byte string that also starts anywhere else are
removed.  Every such string is owned by its smallest ``gram``-byte gram (see
``common.minimisers``), so equal strings have equal owners at equal places, and
only suffixes that start at owners occurring twice or more need sorting: about
one per ``(width - gram) / 2`` bytes of the repeated parts.

An owner with the strings around it is a *stretch*; equal stretches are merged by
partial aggregation first (two copies settle all strings of both).  The distinct
stretches of one owner are sorted by their suffixes from the owner on: a
mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes, so each takes log(width) steps; all pairs
of all groups are compared at once in arrays.  Common extensions of neighbours
in the sorted order, checked byte by byte against hash collisions, tell which
suffixes agree to the right; prefix hashes, also checked, which agree to the
left.  A string is repeated if another suffix agrees with it on both sides.

The stretches of one owner are compared in one task.  Those of an owner with more
than ``most`` of them are first cut into their single strings, which are merged in
the same way as stretches; strings that differ are then no more alike, so nothing
is left to sort.  Equal stretches and strings are told by 128-bit digests of their
bytes, which come with the owner's hash.

Defined results: a null or empty text, or one shorter than ``width``, is kept
whole; strings are judged on the input; repeated rows repeat each other's
strings, so they go whole if long enough; an empty table gives an empty result.
Texts are bytes, so what is kept need not be valid UTF-8.  An id column named like a
result keeps its name, and the result gets a trailing underscore.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    trimmed, binary_buffer, bits_for, gram_hashes, in_filter, key_bits, key_filter, materialize, minimisers, mix, prefix_sums, range_hash, row_key, slices, split_by_bits, text_buffer,
    whole_groups, with_id,
)

WIDTH = 200
GRAM = 50
SLICE = 1 << 19
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit digests of slices of ``data``, shaped (slices, 2)."""
    raw = data.tobytes()
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())), np.int64).reshape(-1, 2)


def _owners(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    sums = prefix_sums(_VALUES[data])
    grams = mix(gram_hashes(sums, gram))
    return sums, grams, minimisers(grams, offsets, gram, width)


def _parts(data: np.ndarray, offsets: np.ndarray, width: int):
    """(bytes, offsets, row numbers, places) of about ``SLICE`` bytes.  A longer text
    comes in overlapping parts, so that each of its strings begins in one of them."""
    for a, b in slices(offsets, SLICE):
        size = int(offsets[b] - offsets[a])
        if size <= 2 * SLICE:
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(a, b), 0
            continue
        for start in range(0, size - width + 1, SLICE):
            part = data[offsets[a] + start : min(offsets[a] + start + SLICE + width - 1, offsets[b])]
            yield part, np.array([0, len(part)]), np.array([a]), start


def _fingerprints(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for part, inner, _, _ in _parts(data, offsets, width):
                _, grams, (owner, *_) = _owners(part, inner, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(grams[owner].view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(trimmed(scan), "h long")


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array of slices of ``data``."""
    edges = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(int(edges[-1])) + np.repeat(start - edges[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data[place].tobytes())])


def _stretches(docs: DataFrame, filter_: np.ndarray, width: int, gram: int) -> DataFrame:
    """(h, row, first, at, n, s1, s2, bytes): where the owner's strings begin, how
    far in the owner lies, how many strings it owns, a digest of the bytes."""

    def scan(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for part, inner, numbers, place in _parts(data, offsets, width):
                _, grams, (owner, lo, hi, row) = _owners(part, inner, width, gram)
                hit = in_filter(filter_, grams[owner])
                owner, lo, hi, row = owner[hit], lo[hit], hi[hit], row[hit]
                n = hi - lo + 1
                whole = _digests(part, lo, hi + width)
                rows = batch.column(1).take(pa.array(numbers[row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[owner].view(np.int64)), rows, pa.array(lo - inner[row] + place), pa.array(owner - lo), pa.array(n), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), _gather(part, lo, n + width - 1)],
                    names=["h", "row", "first", "at", "n", "s1", "s2", "bytes"],
                )

    return docs.select("text", "row").mapInArrow(trimmed(scan), "h long, row binary, first long, at long, n long, s1 long, s2 long, bytes binary")


# ----------------------------------------------------------------- suffix sort


class Suffixes:
    """Suffixes of stretches, from their owners on, by group."""

    def __init__(self, group: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray) -> None:
        self.group, self.data, self.start, self.stop = group, data, start, stop
        self.owner = start + at
        self.sums = prefix_sums(_VALUES[data])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, by binary search."""
        p, q = self.owner[a], self.owner[b]
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.stop[a] - p, self.stop[b] - q)
        for _ in range(int(high.max()).bit_length() if len(high) else 0):
            middle = (low + high + 1) >> 1
            same = range_hash(self.sums, p, p + middle) == range_hash(self.sums, q, q + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; a prefix comes first, ties by index."""
        common = self.extension(a, b)
        p, q = self.owner[a] + common, self.owner[b] + common
        end_a, end_b = p >= self.stop[a], q >= self.stop[b]
        x, y = self.data[np.minimum(p, len(self.data) - 1)], self.data[np.minimum(q, len(self.data) - 1)]
        return np.where(end_a & end_b, a < b, np.where(end_a | end_b, end_a, x < y))

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: every element finds its rank
        in the neighbouring run by binary search."""
        order = np.arange(len(self.group))
        first = np.searchsorted(self.group, self.group, "left")
        last = np.searchsorted(self.group, self.group, "right")
        run = 1
        while True:
            live = np.flatnonzero(last - first > run)
            if not len(live):
                return order
            inside = live - first[live]
            pair = first[live] + inside // (2 * run) * (2 * run)
            left = inside % (2 * run) < run
            low = np.where(left, np.minimum(pair + run, last[live]), pair)
            high = np.where(left, np.minimum(pair + 2 * run, last[live]), pair + run)
            base, mine = low.copy(), order[live]
            for _ in range(int(run).bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                before = self.less(order[middle], mine[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = pair + (live - np.where(left, pair, pair + run)) + (low - base)
            order[place] = mine
            run *= 2

    def agree(self, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> bool:
        """Whether the bytes at p and q are equal over ``size``: no collision."""
        step = max(1, (1 << 20) // max(1, int(size.max(initial=1))))
        for i in range(0, len(p), step):
            n = size[i : i + step]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if (self.data[np.repeat(p[i : i + step], n) + inside] != self.data[np.repeat(q[i : i + step], n) + inside]).any():
                return False
        return True


def repeated_strings(group: np.ndarray, data: np.ndarray, edges: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``n`` strings of each distinct stretch (sorted by group) occur
    in another one of its group: (stretch, place of the string in it)."""
    suffixes = Suffixes(group, data, edges[:-1], edges[1:], at)
    order = suffixes.sort()
    common = np.zeros(len(order), np.int64)  # with the one before
    if len(order) > 1:
        same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        common[same] = suffixes.extension(order[same - 1], order[same])
        if not suffixes.agree(suffixes.owner[order[same - 1]], suffixes.owner[order[same]], common[same]):
            return _plain(group, data, edges, n, width)
    fresh = np.append(True, group[order[1:]] != group[order[:-1]]) if len(order) else np.zeros(0, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    owner, at_, n_ = suffixes.owner[order], at[order], n[order]
    for left in range(int(at.max(initial=-1)) + 1):
        member = np.flatnonzero((at_ >= left) & (at_ - left < n_))
        if len(member) < 2:
            continue
        right = np.cumsum(fresh | (common < width - left))  # suffixes that agree on what is to the right
        key = range_hash(suffixes.sums, owner[member] - left, owner[member]) * np.uint64(2) + np.uint64(1)
        key = mix(key + mix(right[member].astype(np.uint64)))
        by = np.argsort(key, kind="stable")
        twin = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        if not len(twin):
            continue
        a, b = member[by[twin]], member[by[twin + 1]]
        if (right[a] != right[b]).any() or not suffixes.agree(owner[a] - left, owner[b] - left, np.full(len(a), left)):
            return _plain(group, data, edges, n, width)
        hit = order[np.unique(np.concatenate([a, b]))]
        found.append((hit, at[hit] - left))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _plain(group, data, edges, n, width):
    """The same by comparing the strings themselves, for a chunk in which two
    hashes collided."""
    seen: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for i, g in enumerate(group.tolist()):
        for k in range(int(n[i])):
            seen.setdefault((g, data[edges[i] + k : edges[i] + k + width].tobytes()), []).append((i, k))
    hits = [x for places in seen.values() if len(places) > 1 for x in places]
    return np.array([i for i, _ in hits], np.int64), np.array([k for _, k in hits], np.int64)


# -------------------------------------------------------------------- operator


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = 4_000) -> DataFrame:
    """``docs(row, text)`` to (row, first, n): starts of repeated strings."""
    shared = materialize(_fingerprints(docs, width, gram).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "suffix-shared")
    filter_ = key_filter(shared, "h", bits_for(shared.count()))
    same = ["h", "s1", "s2"]
    found = materialize(_stretches(docs, filter_, width, gram).withColumn("occurrence", F.xxhash64("row", "first")), "suffix-stretches")
    distinct = materialize(found.groupBy(*same).agg(F.count("*").alias("copies"), F.min("occurrence").alias("holder")), "suffix-distinct")
    copied = found.select(*same, "row", "first", "n").join(distinct.where("copies > 1").select(*same), same).select("row", "first", "n")

    sizes = distinct.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    holders = materialize(distinct.join(sizes, "h").select(*same, F.col("holder").alias("occurrence"), "size"), "suffix-holders")
    bits = bits_for(holders.count())
    held = split_by_bits(found, materialize(key_bits(holders, "occurrence", bits), "holder-bits"), "occurrence", True, bits).join(holders, [*same, "occurrence"])

    def compare(batches):
        for chunk in whole_groups(batches):
            h, at, n = (np.asarray(chunk.column(i)) for i in (0, 3, 4))
            data, edges = binary_buffer(chunk.column(5))
            group = np.cumsum(np.append(0, h[1:] != h[:-1]))
            which, place = repeated_strings(group, data, edges, at, n, width)
            order = np.lexsort((place, which))
            which, place = which[order], place[order]
            begin = np.append(True, (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)) if len(which) else np.zeros(0, bool)
            start = np.flatnonzero(begin)
            length = np.diff(np.append(start, len(which)))
            first = np.asarray(chunk.column(2))[which[start]] + place[start]
            yield pa.RecordBatch.from_arrays([chunk.column(1).take(pa.array(which[start])), pa.array(first), pa.array(length)], names=["row", "first", "n"])

    columns = ["h", "row", "first", "at", "n", "bytes"]
    normal = held.where(F.col("size") <= most).select(columns).repartition("h").sortWithinPartitions("h")
    compared = normal.mapInArrow(trimmed(compare), "row binary, first long, n long")

    def unpack(batches):
        for batch in batches:
            first, n = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            data, edges = binary_buffer(batch.column(5))
            start = np.repeat(edges[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(np.arange(len(n)), n)
            same = _digests(data, start, start + width)
            yield pa.RecordBatch.from_arrays([pa.array(same[:, 0].copy()), pa.array(same[:, 1].copy()), batch.column(1).take(pa.array(which)), pa.array(first[which] + start - edges[which])], names=["w1", "w2", "row", "first"])

    strings = held.where(F.col("size") > most).select(columns).mapInArrow(trimmed(unpack), "w1 long, w2 long, row binary, first long")
    twice = strings.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    counted = strings.join(twice, ["w1", "w2"]).select("row", "first", F.lit(1).cast("long").alias("n"))
    return copied.unionByName(compared).unionByName(counted)


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = 4_000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row."""
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(source, width, gram, most)
    packed = materialize(ranges.groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("cut")), "suffix-cuts")
    bits = bits_for(packed.count())
    hit = materialize(key_bits(packed, "xxhash64(row)", bits), "cut-bits")  # texts without a cut need not move
    joined = split_by_bits(source, hit, "xxhash64(row)", True, bits).join(packed, "row", "left").select("id", "text", "cut")
    whole = split_by_bits(source, hit, "xxhash64(row)", False, bits).select("id", "text", F.lit(None).cast(packed.schema["cut"].dataType).alias("cut"))
    kind = f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            sizes, removed, spans, digest, kept = [], [], [], [], []
            for i, ranges_ in enumerate(batch.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                ranges_ = ranges_.as_py()
                gone = np.zeros(0, bool)
                if ranges_:
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, [r["first"] for r in ranges_], 1)
                    np.add.at(step, [r["first"] + r["n"] - 1 + width for r in ranges_], -1)
                    gone = np.cumsum(step)[:-1] > 0
                left = (text[~gone] if len(gone) else text).tobytes()
                sizes.append(len(text))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    every = joined.mapInArrow(trimmed(cut), kind).unionByName(whole.mapInArrow(trimmed(cut), kind))
    return with_id(every, id_col)
