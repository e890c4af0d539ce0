"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

SuperMinHash gives every element of a document's shingle set a random
permutation of the signature's places, drawn step by step; place ``p`` keeps the
least ``rank + fraction`` that an element brings to it.  The ranks of one element
are a permutation, hence correlated, and the estimate varies less than that of
independent hashes.  A document stops as soon as no later rank can lower any of
its places, after a few steps for all but tiny documents.

1. Rows with equal shingle sets are one class, represented by its smallest id;
   copies are not expanded.
2. Signatures are cut into bands so that a pair at the threshold misses all of
   them with probability under one in a million; classes that share a band
   share a bucket.
3. Each class is first verified against the bucket leader with which it shares
   most bands.  Union-find over these links settles most of every bucket.
4. Buckets that still hold several components go on to an exact prefix filter:
   with a document's shingles in one global order, rare ones first, two similar
   documents share one of their first ``n - ceil(similarity n) + 1``.  The order
   is by counts in a table of fixed size, which any two documents read alike.
   Pairs that share such a shingle, lie in two components and whose sizes and
   places allow the similarity are verified on the full sets.  A pair is left out
   only if it can't be similar or its classes are connected already, so no
   component is lost; a group of near copies, however large, is linear work, and
   so are many documents that share a frequent passage.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Defined results: fewer
words than a shingle form one shingle; a null or empty text has the empty set
and links with nothing; rows that share an id count as one document with
several texts; in ``near_duplicates``, which reports ids, rows without one link
only with rows of equal sets, while ``drop_near_duplicates`` takes each as a
document of its own; an empty table gives an empty result.  Ids that are no whole
numbers are numbered in their order first; an id column named like a result keeps its
name, and the result gets a trailing underscore.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bits_for, components, key_bits, materialize, mix, numbered, renamed, row_key, slices, split_by_bits, text_buffer, trimmed, with_id, word_stream

SIGNATURE = 252
_C1, _C2, _C3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    stream, at = word_stream(data, offsets, hashes, lower=True)
    grams = np.zeros(0, np.uint64)
    if len(stream) >= k:
        acc = np.zeros(len(stream) - k + 1, np.uint64)
        for j in range(k):
            acc = mix(acc * _C1 + stream[j : j + len(acc)])
        grams = acc
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = mix(one * _C2 + stream[j : j + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """Signatures (rank in the high, fraction in the low 32 bits); an empty set's
    is all ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    best = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    if not sizes.sum():
        return best
    element, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
    flat, alive = best.reshape(-1), np.arange(len(element))
    for j in range(m):
        r = mix(element * _C2 + np.uint64(j * int(_C3) & 0xFFFFFFFFFFFFFFFF))
        pick = j + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        place = order[alive, pick]
        order[alive, pick] = order[alive, j]
        np.minimum.at(flat, row * m + place, (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
        rows = np.unique(row)
        open_ = np.zeros(len(sets), bool)
        open_[rows] = (best[rows].max(axis=1) >> np.uint64(32)) > j
        go = open_[row]
        if not go.all():
            element, row, alive = element[go], row[go], alive[go]
        if not len(row):
            break
    return best


def signatures(sets: list[np.ndarray], m: int = SIGNATURE, limit: int = 1 << 16) -> np.ndarray:
    """``super_minhash`` with memory for about ``limit`` elements at a time: the places of
    a larger set are the least of those of its parts."""
    out = np.empty((len(sets), m), np.uint64)
    start = 0
    while start < len(sets):
        stop, size = start + 1, len(sets[start])
        while stop < len(sets) and size + len(sets[stop]) <= limit:
            size += len(sets[stop])
            stop += 1
        if size <= limit:
            out[start:stop] = super_minhash(sets[start:stop], m)
        else:
            parts = (super_minhash([sets[start][i : i + limit]], m) for i in range(0, size, limit))
            out[start:stop] = reduce(np.minimum, parts)
        start = stop
    return out


def band_shape(similarity: int, m: int = SIGNATURE, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows of each): the longest bands that keep a pair at the threshold."""
    t = similarity / 100
    rows = max(r for r in range(1, m + 1) if r == 1 or (1 - t**r) ** (m // r) <= miss)
    return m // rows, rows


def sketches(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """``docs(id, text, row)`` to (id, row, n, hi, lo, bands): the set's size, its digest
    and band keys."""
    bands, rows = band_shape(similarity)

    def sketch(batches):
        hashes = WordHashes()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, 300_000):
                part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                sets = shingle_sets(part, inner, k, hashes)
                signature = signatures(sets)[:, : bands * rows].reshape(len(sets), bands, rows)
                key = np.zeros((len(sets), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * _C1 + signature[:, :, r])
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32)), pa.array(key.view(np.int64).ravel())),
                    ],
                    names=["id", "row", "n", "hi", "lo", "bands"],
                )

    return docs.select("id", "text", "row").mapInArrow(trimmed(sketch), "id long, row binary, n long, hi long, lo long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        hashes = WordHashes()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (da, oa), (db, ob) = (text_buffer(batch.column(batch.schema.get_field_index(c))) for c in ("text_a", "text_b"))
            for a, b in slices(oa + ob, 4 << 20):
                sa = shingle_sets(da[oa[a] : oa[b]], oa[a : b + 1] - oa[a], k, hashes)
                sb = shingle_sets(db[ob[a] : ob[b]], ob[a : b + 1] - ob[a], k, hashes)
                for i, (x, y) in enumerate(zip(sa, sb)):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep[a + i] = 100 * both >= similarity * (len(x) + len(y) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(trimmed(check), "a long, b long")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of some ids; a filter of fixed size spares most others the shuffle."""
    size = bits_for(nodes.count())
    bits = materialize(key_bits(nodes.select(F.xxhash64("node").alias("h")), "h", size), "node-bits")
    source = docs.select("id", "text", F.xxhash64("id").alias("h"))
    return split_by_bits(source, bits, "h", True, size).select("id", "text").join(nodes.select(F.col("node").alias("id")), "id", "left_semi")


def crossing_pairs(nodes: DataFrame, texts: DataFrame, k: int, similarity: int, slots: int = 1 << 21) -> DataFrame:
    """``nodes(node, label)`` to the pairs (a, b) of different labels that the prefix
    filter leaves.  slots: how many counters order the shingles; more only prune
    better."""
    rows = materialize(texts.join(nodes.withColumnRenamed("node", "id"), "id").select("id", "label", "text"), "open-texts")

    def each(batches):
        hashes = WordHashes()
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in slices(offsets, 4 << 20):
                yield batch.slice(a, b - a), shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, hashes)

    def count(batches):
        total = np.zeros(slots, np.int64)
        for _, sets in each(batches):
            for shingles in sets:
                np.add.at(total, (shingles & np.uint64(slots - 1)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 1 << 16):
            some = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "c"])

    counted = rows.mapInArrow(trimmed(count), "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    weights = np.zeros(slots, np.int32)
    weights[np.asarray(counted["slot"].combine_chunks())] = np.minimum(np.asarray(counted["c"].combine_chunks()), np.iinfo(np.int32).max)
    shared = nodes.sparkSession.sparkContext.broadcast(weights)

    def prefixes(batches):
        weight = shared.value
        for part, sets in each(batches):
            heads, places, sizes = [], [], []
            for shingles in sets:
                n = len(shingles)
                head = n - -(-similarity * n // 100) + 1 if n else 0
                order = np.lexsort((shingles, weight[(shingles & np.uint64(slots - 1)).astype(np.int64)]))[:head]
                heads.append(shingles[order])
                places.append(np.arange(1, len(order) + 1))
                sizes.append(n)
            lengths = [len(h) for h in heads]
            take = pa.array(np.repeat(np.arange(len(sets)), lengths))
            token = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(token), pa.array(place), pa.array(np.repeat(np.array(sizes, np.int64), lengths))], names=["node", "label", "token", "i", "n"])

    heads = materialize(rows.mapInArrow(trimmed(prefixes), "node long, label long, token long, i long, n long"), "prefixes")
    by_label = heads.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = by_label.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("m.label").alias("main"))
    inside = materialize(heads.join(main, "token"), "shared-prefixes")
    few = inside.where("label <> main").selectExpr("token", "node as x", "label as lx", "i as ix", "n as nx")
    all_ = inside.selectExpr("token", "node as y", "label as ly", "i as iy", "n as ny")
    sizes = f"nx * 100 >= ny * {similarity} and ny * 100 >= nx * {similarity}"
    places = f"(1 + least(nx - ix, ny - iy)) * {100 + similarity} >= {similarity} * (nx + ny)"
    crossing = few.join(all_, "token").where(f"lx <> ly and {sizes} and {places}")
    return crossing.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: int = 80) -> DataFrame:
    """(id, row, n_shingles, component_id, kept): ``component_id`` is the smallest
    id reachable over links of ``similarity`` percent or more, ``row`` is
    ``common.row_key``.  Ids are of any type that has an order."""
    source, names = numbered(docs.select(id_col, text_col), id_col)
    found = _labelled(source.select(F.col("__tm_id").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row")), k, similarity)
    return with_id(renamed(found, names, ("id", "component_id")), id_col)


def _labelled(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """``docs(id, text, row)`` to (id, row, n_shingles, component_id, kept)."""
    sketch = materialize(sketches(docs, k, similarity), "sketches")
    classes = materialize(sketch.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("node"), F.first("n").alias("n")), "classes")
    own = sketch.where("n > 0").join(classes.select("hi", "lo", "node"), ["hi", "lo"]).where("id = node")
    banded = own.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    buckets = materialize(banded.join(shared.select("key", "leader"), "key").distinct(), "buckets")
    nodes = materialize(buckets.select("node").distinct(), "nodes")
    texts = materialize(_texts_of(docs, nodes), "texts")

    stars = buckets.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    stars = stars.groupBy("node").agg(F.max(F.struct("c", "leader")).alias("m")).select(F.col("node").alias("a"), F.col("m.leader").alias("b"))
    links = materialize(verified(stars, texts, k, similarity), "star-links")
    found = components(links)

    label = F.coalesce("root", "node").alias("label")
    labelled = materialize(buckets.select("key", "node").join(found, "node", "left").select("key", "node", label), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    open_ = materialize(labelled.join(mixed, "key", "left_semi").select("node", "label").distinct(), "open-nodes")
    pairs = materialize(crossing_pairs(open_, texts, k, similarity), "crossing-pairs")
    if not pairs.isEmpty():
        more = materialize(verified(pairs, texts, k, similarity), "crossing-links")
        found = components(links.unionByName(more))

    smallest = found.groupBy("root").agg(F.min("node").alias("least"))
    members = found.join(smallest, "root").select("node", F.least("least", "root").alias("component"))
    classed = classes.join(members, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    rows = sketch.select("id", "row", "n", "hi", "lo").join(classed, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return rows.select("id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _drop(rows: DataFrame, k: int, similarity: int) -> DataFrame:
    """``rows(id, text, row)`` with one row of each component; whatever ``row`` holds stays."""
    found = materialize(near_duplicates(rows, "id", "text", k, similarity), "near-duplicates")
    gone = materialize(found.where("not kept").select("row").distinct(), "dropped-rows").withColumnRenamed("row", "key")
    again = found.where(F.col("kept") & F.col("id").isNotNull()).groupBy("row").agg(F.count("*").alias("c")).where("c > 1").select(F.col("row").alias("key"))
    every = rows.select("row", "id", "text", row_key("id", "text").alias("key"))
    size = bits_for(gone.count())
    bits = materialize(key_bits(gone, "xxhash64(key)", size), "dropped-bits")  # most rows stay where they are
    inside = split_by_bits(every, bits, "xxhash64(key)", True, size).join(gone, "key", "left_anti").select(*every.columns)
    left = split_by_bits(every, bits, "xxhash64(key)", False, size).unionByName(inside)
    again = materialize(again, "repeated-rows")
    if not again.isEmpty():
        once = left.join(again, "key", "left_semi").dropDuplicates(["key"])
        left = left.join(again, "key", "left_anti").unionByName(once)
    return left.select("row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, once if
    its row is repeated.  Rows without an id group and link by a key of their text
    that comes after all ids below 2**62, and equal texts among them are one row.
    Columns keep their names, whatever these are."""
    rows = numbered(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")[0]
    rows = rows.select("row", F.col("__tm_id").alias("id"), "text")
    missing = F.col("id").isNull()
    if not rows.where(missing).isEmpty():
        unnamed = missing & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # texts without words link with nothing
        once = materialize(rows.where(unnamed).dropDuplicates(["text"]), "unnamed")
        key = F.when(unnamed, F.xxhash64("text").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)).otherwise(F.col("id"))
        rows = rows.where(~unnamed).unionByName(once).withColumn("id", key)
    return _drop(rows, k, similarity).select("row.*")
