"""Shared pieces of the llm operators: durable intermediate tables, zero-copy
access to text columns, vectorised hashing, minimiser sampling and connected
components.

Conventions
-----------
* A null text is an empty text.
* Operators first select the columns that they need, so that further columns,
  whatever their names, never clash with internal ones.
* ``row_key`` identifies a row by its id *and* text: repeated rows share a key
  and get equal results; two different texts under one id stay apart.
* Intermediate tables are Parquet files in the shared folder named by
  ``spark.checkpoint.dir``; a lost executor costs only recomputation from them.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import shared_dir

def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/trailmark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(f):
    """``f`` for mapInArrow, giving memory back when a partition ends: Spark keeps the
    worker for later tasks of any kind."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits, as binary."""
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(name).cast("string"), F.lit(":"), name, F.coalesce(F.col(text_col), F.lit("")))))


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with its ids as longs in ``__tm_id``, and what these stand for: None where
    ids are whole numbers, which stay; ids of another type are numbered in their order,
    (number, name), so that the smallest number is the smallest id."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return docs.withColumn("__tm_id", F.col(id_col).cast("long")), None
    ids = docs.select(F.col(id_col).alias("__tm_name")).where("__tm_name is not null").distinct().orderBy("__tm_name")
    names = materialize(ids.select(F.monotonically_increasing_id().alias("number"), F.col("__tm_name").alias("name")), "id-numbers")
    own = names.select(F.col("number").alias("__tm_id"), F.col("name").alias("__tm_name"))
    return docs.join(own, F.col(id_col) == F.col("__tm_name"), "left").drop("__tm_name"), names


def renamed(rows: DataFrame, names: DataFrame | None, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with the numbers in ``columns`` put back to the ids they stand for."""
    if names is None:
        return rows
    order = rows.columns
    for c in columns:
        back = names.select(F.col("number").alias(c), F.col("name").alias("__tm_name"))
        rows = rows.join(back, c, "left").drop(c).withColumnRenamed("__tm_name", c)
    return rows.select(order)


def with_id(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with its column ``id`` called ``id_col``; a result of that name gets a
    trailing underscore."""
    others = [c for c in rows.columns if c != "id"]
    return rows.select(F.col("id").alias(id_col), *[F.col(c).alias(f"{c}_" if c.lower() == id_col.lower() else c) for c in others])


# ---------------------------------------------------------------- text access


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without a copy: (bytes, offsets)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Ranges of rows holding about ``limit`` bytes each (one row at least)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


# -------------------------------------------------------------------- hashing

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else len(have) * 2)
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = _powers[int(base)] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_sums(values: np.ndarray, base_inv: np.uint64 = _BINV) -> np.ndarray:
    """Prefix polynomial hashes: S[i] = sum of values[j] * base**-j, j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base_inv, len(values)), out=out[1:], dtype=np.uint64)
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, base: np.uint64 = _B) -> np.ndarray:
    """Hash of values[start:stop] for arrays of ranges, wherever they lie."""
    return (sums[stop] - sums[start]) * powers(base, len(sums))[start]


def gram_hashes(sums: np.ndarray, k: int, base: np.uint64 = _B) -> np.ndarray:
    """Hashes of all runs of ``k`` values."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return (sums[k:] - sums[:n]) * powers(base, len(sums))[:n]


class WordHashes(dict):
    """Word (bytes) to two independent 64-bit hashes, remembered for a bounded number
    of words."""

    def __init__(self, limit: int = 120_000) -> None:
        super().__init__()
        self.limit = limit
        self.first, self.second = np.zeros(limit, np.uint64), np.zeros(limit, np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        both = xxhash.xxh3_128_intdigest(word)
        self.first[place], self.second[place] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        return place

    def both(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for i in range(0, len(words), self.limit // 2):
            some = words[i : i + self.limit // 2]
            if len(self) + len(some) > self.limit:  # as many may be new
                self.clear()
            place = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            out.append((self.first[place], self.second[place]))
        none = np.zeros(0, np.uint64)
        return tuple(np.concatenate([none, *(x[k] for x in out)]) for k in (0, 1))

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.both(words)[0]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_parts(raw: bytes, limit: int = 4 << 20):
    """A text as it is, or, if it is long, in parts cut between words."""
    start = 0
    while len(raw) - start > limit:
        found = _SPACE.search(raw, start + limit)
        stop = found.start() if found else len(raw)
        yield raw[start:stop]
        start = stop
    yield raw[start:]


def word_streams(data: np.ndarray, offsets: np.ndarray, hashes: WordHashes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row and the rows'
    offsets among them.  bytes.split() splits at exactly those bytes and
    bytes.lower() changes A-Z only."""
    none = np.zeros(0, np.uint64)
    parts, counts = [(none, none)], np.zeros(len(offsets), np.int64)
    raw = data.tobytes()
    if lower:
        raw = raw.lower()
    for i in range(len(offsets) - 1):
        for part in word_parts(raw[offsets[i] : offsets[i + 1]]):
            words = part.split()
            counts[i + 1] += len(words)
            if words:
                parts.append(hashes.both(words))
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]), np.cumsum(counts)


def word_stream(data: np.ndarray, offsets: np.ndarray, hashes: WordHashes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    first, _, at = word_streams(data, offsets, hashes, lower)
    return first, at


# ---------------------------------------------------------- minimiser sampling


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, in linear time."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def minimisers(grams: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Every run of ``window`` values within a row is owned by its smallest
    k-gram (the leftmost of equal ones), so equal runs are owned by equal
    k-grams at equal distances.  ``grams``: hashes of all k-grams of the
    concatenated rows.  Returns per owner (k-gram position, first and last
    owned run, row)."""
    rows = np.flatnonzero(np.diff(offsets) >= window)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none, none
    shift = np.uint64(max(int(len(grams)).bit_length(), 1))
    key = (mix(grams) >> shift << shift) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min(key, window - k + 1) & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(owner) + 1, np.int8)
    valid[offsets[rows]] += 1
    valid[offsets[rows + 1] - window + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (owner[1:] != owner[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return owner[lo], lo, hi, np.searchsorted(offsets, lo, "right") - 1


# ------------------------------------------------------------- grouped batches


def whole_groups(batches, limit: int = 20_000):
    """Record batches, cut so that no group (equal ``h``, in order) is in two."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = np.asarray(table.column(0))
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if cut:
                for start in _group_cuts(h[:cut], limit):
                    yield table.slice(*start)
            held = [table.slice(cut)]
            rows = table.num_rows - cut
    if held:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for start in _group_cuts(np.asarray(table.column(0)), limit):
            yield table.slice(*start)


def _group_cuts(h: np.ndarray, limit: int):
    """(start, length) of pieces of about ``limit`` rows that end where h changes."""
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    start = 0
    while start < len(h):
        stop = int(ends[min(np.searchsorted(ends, start + limit), len(ends) - 1)])
        yield start, stop - start
        start = stop


def binary_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]], edges - edges[0]


# ------------------------------------------------------------- bounded filters


BITS = 1 << 25


def bits_for(keys: int, most: int = 1 << 28) -> int:
    """The size of a filter for so many keys: sixteen bits a key, up to 32 MB."""
    return min(most, 1 << max(16, (16 * keys).bit_length()))


def key_bits(keys: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """A one-hash Bloom filter over a long column as a table (w, b) of 64-bit words:
    ``bits / 64`` rows at most, whatever the number of keys.  It only saves work:
    who uses it joins the exact keys afterwards."""
    word, bit = _place(column, bits)
    return keys.select(word.alias("w"), F.expr(f"shiftleft(1L, {bit})").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def _place(column: str, bits: int) -> tuple[Column, str]:
    return F.expr(f"pmod({column}, {bits}L) div 64"), f"cast(pmod({column}, 64L) as int)"


def key_filter(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The same as an array of ``bits`` bits, for tasks that compute their keys."""
    rows = key_bits(keys, column, bits).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[np.asarray(rows["w"].combine_chunks())] = np.asarray(rows["b"].combine_chunks()).view(np.uint64)
    return out


def split_by_bits(source: DataFrame, table: DataFrame, key: str, inside: bool, bits: int = BITS) -> DataFrame:
    """The rows whose long ``key`` passes a filter, or those that do not.  The filter's
    size is fixed, so it is broadcast."""
    word, bit = _place(key, bits)
    passes = (word == F.col("__tm_w")) & F.expr(f"(shiftrightunsigned(__tm_b, {bit}) & 1L) = 1L")
    return source.join(F.broadcast(table.toDF("__tm_w", "__tm_b")), passes, "left_semi" if inside else "left_anti")


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``keys``: uint64 views of the longs."""
    bits = len(table) << 6
    slot = keys & np.uint64(bits - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


# ------------------------------------------------------------------ union-find


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: (node, root) for every node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    parent = np.array(parent)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return nodes, nodes[parent]
        parent = up


def _gathered(batches, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """A partition's edges as a forest (node, root); memory follows its nodes."""
    a, b, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    rows = 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        rows += batch.num_rows
        if rows > keep:
            a, b = _forest(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            held, rows = [], 0
    return _forest(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))


def _local_forests(batches):
    nodes, roots = _gathered(batches, 200_000)
    keep = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])


def _whole_forest(batches):
    nodes, roots = _gathered(batches, 200_000)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "up"])


def components(edges: DataFrame, few: int = 250_000) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: (node, root).

    Union-find within each partition thins the edges to forests; then every node
    joins the neighbour of smallest hash (fresh hashes each round, so chains
    shrink by a constant factor) until at most ``few`` edges are left, which one
    task settles by union-find.  Aggregation is by partial minima, so a node with
    very many edges is no hot spot."""
    links = materialize(edges.select("a", "b").where("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while (n := links.count()) > few:
        seed = len(steps)
        links = links.mapInArrow(trimmed(_local_forests), "a long, b long")
        both = links.unionByName(links.selectExpr("b as a", "a as b"))
        order = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("n"))
        near = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = materialize(near.select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["n"].alias("up")), "parents")
        steps.append(step)
        p, q = step.selectExpr("node as a", "up as pa"), step.selectExpr("node as b", "up as pb")
        links = materialize(links.join(p, "a").join(q, "b").selectExpr("pa as a", "pb as b").where("a <> b").distinct(), "links")
    if n:
        steps.append(materialize(links.coalesce(1).mapInArrow(trimmed(_whole_forest), "node long, up long"), "parents"))
    if not steps:
        return links.selectExpr("a as node", "b as root")
    out = steps[0].withColumnRenamed("up", "root")
    for step in steps[1:]:
        nxt = step.selectExpr("node as root", "up")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out
