"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the exact neighbour graph, a balanced partitioning of that
graph (recursive median cuts, then moves that bring a vector to the part where
most of its neighbours are, within a capacity), and a small network that predicts
in which parts a vector's neighbours lie.  The network then assigns every row of
the table to its most probable part, and routes a query to its several most
probable parts, in which all rows are compared exactly in double precision.  The
number of parts a query visits is the least that reaches ``target`` of the true
neighbours on held-out sample vectors.

There are about as many parts as the square root of the table's rows, at any size.
Where that is more than ``most_parts``, every part is partitioned once more in the same
way, on a sample of its own rows, and a query visits several parts of each of its
parts.  Networks are fitted in tasks, on ``sample`` rows at most each.

Parts stand together on shelves of ``block`` rows at most; a part with more is split by
a hash of the row, as are a shelf's queries, so no task holds an unbounded group.  A
query's vector is sent once to every shelf with some of its parts, and nearest rows are
merged from partial top lists.  A query that finds fewer than ``k`` rows visits all parts.

Defined results: vectors that are null, empty, zero, of another length than most
or with null or non-finite components take no part, neither as queries nor as
candidates; rows that share an id count as the query's own, and each row that is
selected has a list of its own; a candidate that occurs twice is listed twice; ties go
to the smaller id; fewer than ``k`` candidates give shorter lists.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed

#: Bound of the sample that a partition and its network are fitted on.
SAMPLE = 10_000
#: Parts of one partition: at most so many, and so many sample vectors for each.
PARTS, PER_PART = 256, 20


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# -------------------------------------------------------------------- learning


def neighbour_graph(x: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """Indices of the ``k`` nearest others of each row (or of some rows)."""
    rows = np.arange(len(x)) if queries is None else queries
    out = np.empty((len(rows), min(k, len(x) - 1)), np.int64)
    y = x.astype(np.float32)
    for i in range(0, len(rows), 1000):
        some = rows[i : i + 1000]
        score = y[some] @ y.T
        score[np.arange(len(some)), some] = -np.inf
        out[i : i + 1000] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """A part for each vector such that few graph edges are cut and no part has
    more than ``slack`` times its share."""
    label = np.zeros(len(x), np.int64)
    todo, used = [(np.arange(len(x)), parts)], 0
    while todo:
        rows, n = todo.pop()
        if n == 1:
            label[rows] = used
            used += 1
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred.T @ centred, hermitian=True)[0][:, 0]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    most = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < most:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Two dense layers: the probability that a vector's neighbours lie in each part."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.maximum(x @ a + b, 0) @ c + d
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @staticmethod
    def fit(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, batch: int = 256, rate: float = 2e-3) -> Router:
        rng = np.random.default_rng(7)
        n, d = x.shape
        p = target.shape[1]
        w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                rows = order[i : i + batch]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                g = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                gh = (g @ w[2].T) * (h > 0)
                t += 1
                for j, grad in enumerate((x[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.999 * v[j] + 0.001 * grad * grad
                    w[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return Router(w)


class Partitions:
    """The fitted router and how many parts a query visits."""

    def __init__(self, router: Router | None, parts: int, visits: int) -> None:
        self.router, self.parts, self.visits = router, parts, visits

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each vector, most probable first."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        chance = self.router(x)
        return np.argsort(-chance, axis=1, kind="stable")[:, :n]

    @staticmethod
    def fit(sample: np.ndarray, parts: int, k: int = 5, graph_k: int = 10, target: float = 0.96) -> Partitions:
        x = np.unique(_unit(sample), axis=0) if len(sample) else sample  # copies teach nothing
        x = x[np.random.default_rng(5).permutation(len(x))]
        parts = min(parts, max(1, len(x) // PER_PART))
        if parts < 2:
            return Partitions(None, 1, 1)
        graph = neighbour_graph(x, graph_k)
        label = balanced_partition(x, graph, parts)
        wish = np.zeros((len(x), parts))
        np.add.at(wish, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        wish[np.arange(len(x)), label] += 1
        wish /= wish.sum(axis=1, keepdims=True)
        held = len(x) // 10  # the number of visits is chosen on vectors that the trial router has not seen
        trial = Router.fit(x[held:], wish[held:])
        chance = trial(x)
        near = neighbour_graph(x, k, np.arange(held))
        place = np.argsort(np.argsort(-chance[:held], axis=1, kind="stable"), axis=1)
        needed = np.take_along_axis(place, chance.argmax(axis=1)[near], axis=1) + 1
        found = np.cumsum(np.bincount(needed.ravel(), minlength=parts + 1)) / needed.size
        return Partitions(Router.fit(x, wish), parts, max(1, int(np.argmax(found >= target))))


class Leaves:
    """One partition, or a partition of partitions: a leaf is a part of a part."""

    def __init__(self, top: Partitions, below: dict[int, Partitions]) -> None:
        self.top, self.below = top, below
        self.width = max((m.parts for m in below.values()), default=1)
        self.count = top.parts if not below else sum(below[p].parts if p in below else 1 for p in range(top.parts))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        part = self.top.ranked(x, 1)[:, 0]
        leaf = part * self.width
        for p in np.unique(part).tolist():
            if p in self.below:
                rows = np.flatnonzero(part == p)
                leaf[rows] += self.below[p].ranked(x[rows], 1)[:, 0]
        return leaf

    def route(self, x: np.ndarray, visits: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) of the leaves to visit; visits: parts of every partition, or
        as many as each was fitted for."""
        first = self.top.ranked(x, visits or self.top.visits)
        query, part = np.repeat(np.arange(len(x)), first.shape[1]), first.ravel()
        if not self.below:
            return query, part
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for p in np.unique(part).tolist():
            rows = query[part == p]
            model = self.below.get(p)
            inner = model.ranked(x[rows], visits or model.visits) if model else np.zeros((len(rows), 1), np.int64)
            out.append((np.repeat(rows, inner.shape[1]), p * self.width + inner.ravel()))
        return np.concatenate([q for q, _ in out]), np.concatenate([f for _, f in out])


# ------------------------------------------------------------------- operator


def _fitted(parts: int, sample: int, target: float):
    """Vectors (v) of one task, at most ``sample`` of them, to a pickled partition."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(b.column(0)) for b in batches if b.num_rows]
        x = np.concatenate(held)[:sample] if held else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Partitions.fit(x, parts, target=target))], pa.binary())], names=["model"])

    return fit


def fit_leaves(vectors: DataFrame, sample: int = SAMPLE, most_parts: int = PARTS, target: float = 0.96) -> Leaves:
    """``vectors(id, v)``: about as many leaves as the root of the number of rows.  A sample
    holds the rows of the smallest hashes of their ids."""
    n = vectors.count()
    wanted = max(1, round(n**0.5))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").coalesce(1)
    inner = -(-wanted // most_parts)
    aim = target if inner == 1 else target**0.5
    row = chosen.mapInArrow(trimmed(_fitted(min(wanted, most_parts), sample, aim)), "model binary").first()
    top = pickle.loads(row[0]) if row else Partitions(None, 1, 1)
    if inner == 1 or top.parts < 2:
        return Leaves(top, {})

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(top.ranked(_unit(x), 1)[:, 0] if len(x) else [], pa.int32()), batch.column(0), batch.column(1)], names=["part", "id", "v"])

    def below(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        (model,) = _fitted(inner, sample, aim)(iter(table.select(["v"]).combine_chunks().to_batches()))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "model": model.column(0)})

    placed = vectors.select("id", "v").mapInArrow(trimmed(place), "part int, id long, v array<double>")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    few = placed.join(F.broadcast(sizes), "part").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("rows"))  # sizes: a row per part
    rows = few.select("part", "v").groupBy("part").applyInArrow(below, "part int, model binary").collect()
    return Leaves(top, {r["part"]: pickle.loads(r["model"]) for r in rows})


def _shelves(rows_of: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each leaf, and the slots of each shelf.  A shelf is a run of leaves with
    ``most`` rows together; a leaf with more is a shelf of its own, in slots."""
    shelf, slots, held = np.zeros(len(rows_of), np.int64), [0], 0
    for leaf, rows in enumerate(rows_of.tolist()):
        if held + rows > most and held:
            slots.append(0)
            held = 0
        held += rows
        shelf[leaf] = len(slots) - 1
        slots[-1] = max(1, -(-held // most))
    return shelf, np.array(slots, np.int64)


def nearest(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample: int = SAMPLE, block: int = 1 << 16, visits: int | None = None, most_parts: int = PARTS, target: float = 0.96
) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest rows found for every row that
    ``queries`` selects.

    Leaves stand on shelves of ``block`` rows at most, fewer in small tables, so that all
    cores have some.  A query's vector goes once to each shelf that holds some of its
    leaves, with their numbers."""
    session = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = source.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    source = source.where(F.size("v") == (sizes["d"] if sizes else 0))
    fitted = fit_leaves(source.select("id", "v"), sample, most_parts, target)
    shared = session.sparkContext.broadcast(fitted)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(2))
            leaf = shared.value.place(_unit(x)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(leaf, pa.int32())], names=["row", "id", "v", "q", "leaf"])

    numbered = source.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "v", "q")
    index = materialize(numbered.mapInArrow(trimmed(place), "row long, id long, v array<double>, q boolean, leaf int"), "ann-index")
    counts = np.zeros(fitted.width * fitted.top.parts, np.int64)  # as many as leaves: 65,536 at most
    for r in index.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    shelf_rows = max(min(block, int(counts.sum()) // (4 * session.sparkContext.defaultParallelism)), min(block, 4096))
    shelf_of, slots = _shelves(counts, shelf_rows)
    layout = session.sparkContext.broadcast((shelf_of, slots))
    asked = index.where("q").select("row", "id", "v")
    keyed = "shelf int, slot int, lot int"

    def keys(shelf: np.ndarray, slot: np.ndarray, lot: np.ndarray) -> list[pa.Array]:
        return [pa.array(x, pa.int32()) for x in (shelf, slot, lot)]

    def store(lots: int):
        """Rows at their shelves, once for each lot of queries."""

        def run(batches):
            shelves, counted = layout.value
            for batch in batches:
                leaf, row = np.asarray(batch.column(3)), np.asarray(batch.column(0))
                shelf = shelves[leaf]
                slot = row * 2654435761 % (1 << 31) % counted[shelf]
                for lot in range(lots):
                    yield pa.RecordBatch.from_arrays([*keys(shelf, slot, np.full(len(shelf), lot)), *batch.columns], names=["shelf", "slot", "lot", "row", "id", "v", "leaf"])

        return index.select("row", "id", "v", "leaf").mapInArrow(run, f"{keyed}, row long, id long, v array<double>, leaf int")

    def route(lots: int, everywhere: bool):
        """Queries at the shelves of their leaves, in every slot of these."""

        def run(batches):
            shelves, counted = layout.value
            for batch in batches:
                x = _matrix(batch.column(2))
                if not len(x):
                    continue
                if everywhere:
                    query, leaf = np.divmod(np.arange(len(x) * len(shelves)), len(shelves))
                else:
                    query, leaf = shared.value.route(_unit(x), visits)
                order = np.lexsort((leaf, shelves[leaf], query))
                query, leaf = query[order], leaf[order]
                pair = query * len(counted) + shelves[leaf]
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(pair)), pa.int32()), pa.array(leaf, pa.int32()))
                q, shelf = query[first], shelves[leaf[first]]
                copy = np.repeat(np.arange(len(q)), counted[shelf])
                slot = np.arange(len(copy)) - np.repeat(np.cumsum(counted[shelf]) - counted[shelf], counted[shelf])
                lot = np.asarray(batch.column(0))[q[copy]] % lots
                taken = pa.array(q[copy])
                yield pa.RecordBatch.from_arrays(
                    [*keys(shelf[copy], slot, lot), batch.column(0).take(taken), batch.column(1).take(taken), batch.column(2).take(taken), lists.take(pa.array(copy))],
                    names=["shelf", "slot", "lot", "row", "id", "v", "leaves"],
                )

        return run

    def compare(asked_: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if asked_.num_rows and rows.num_rows:
            q, c, leaf = (np.asarray(t[n].combine_chunks()) for t, n in ((asked_, "id"), (rows, "id"), (rows, "leaf")))
            x, y = _matrix(asked_["v"]), _matrix(rows["v"])
            ux, uy = _unit(x), _unit(y)
            lists = asked_["leaves"].combine_chunks()
            wanted, of = np.asarray(lists.flatten()), np.repeat(np.arange(len(q)), np.asarray(lists.value_lengths()))
            by_leaf = np.argsort(leaf, kind="stable")
            for number in np.unique(leaf).tolist():
                here = by_leaf[np.searchsorted(leaf[by_leaf], number) : np.searchsorted(leaf[by_leaf], number, "right")]
                who = of[wanted == number]
                step = max(1, (16 << 20) // (8 * len(here)))
                for i in range(0, len(who), step):
                    some = who[i : i + step]
                    score = ux[some] @ uy[here].T
                    score[q[some, None] == c[None, here]] = -np.inf
                    least = -np.partition(-score, min(k, len(here)) - 1, axis=1)[:, min(k, len(here)) - 1] - 1e-9
                    a, b = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                    for part, values in zip(out, (some[a], here[b], cosine(x[some[a]], y[here[b]]))):
                        part.append(values)
            a, b, exact = (np.concatenate(p) for p in out)
            order = np.lexsort((b, c[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
            a, b, exact = a[keep], b[keep], exact[keep]
            row, cand = np.asarray(asked_["row"].combine_chunks())[a], np.asarray(rows["row"].combine_chunks())[b]
            return pa.table({"row": pa.array(row), "query_id": pa.array(q[a]), "cand": pa.array(cand), "vec": pa.array(c[b]), "score": pa.array(exact)})
        empty = pa.array([], pa.int64())
        return pa.table({"row": empty, "query_id": empty, "cand": empty, "vec": empty, "score": pa.array([], pa.float64())})

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec", "cand")

    def search(sent: DataFrame, lots: int) -> DataFrame:
        on = ["shelf", "slot", "lot"]
        found = sent.groupBy(*on).cogroup(store(lots).groupBy(*on)).applyInArrow(compare, "row long, query_id long, cand long, vec long, score double")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def routed(rows: DataFrame, everywhere: bool) -> tuple[DataFrame, int]:
        lots = max(1, -(-rows.count() // shelf_rows))  # a shelf gets a query once: so many rows at most
        return rows.mapInArrow(trimmed(route(lots, everywhere)), f"{keyed}, row long, id long, v array<double>, leaves array<int>"), lots

    found = materialize(search(*routed(asked, False)), "ann-found")
    full = found.groupBy("row").count().where(F.col("count") >= k).select("row")
    short = materialize(asked.join(full, "row", "left_anti"), "ann-short")
    if not short.isEmpty():  # these go to every leaf
        found = found.join(short.select("row"), "row", "left_anti").unionByName(search(*routed(short, True)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results."""
    sx, sy = np.abs(x).max(axis=1, keepdims=True, initial=0), np.abs(y).max(axis=1, keepdims=True, initial=0)
    x, y = x / sx, y / sy
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
