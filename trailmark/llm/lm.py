"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each in the node of its already decided bits;
its contexts are the last 0, 1, ... ``DEPTH`` bytes.  Every (context, node) has a
Krichevsky-Trofimov estimate from its training counts, and context-tree
weighting mixes the estimates of all depths: a node's weighted probability is
half its own estimate and half the product of its children's.  The probability
of a bit is then the mixture over the depths of its path, by the posterior weight
of ending there.  Texts begin after, and end with, the byte 0xFF, which UTF-8
never holds, so the probabilities of all texts sum to one.

Training is counting: each task counts its (context, byte) grams and words with
few keys sent; counts are summed by partial aggregation.  A gram's code holds the
most recent context byte highest, so a subtree is a range of codes.  Whole
subtrees of the three most recent bytes are weighted together, many to a group;
the levels above follow by aggregation upwards, and the weights that they leave
to each subtree by joins downwards.  A gram without training counts changes no
weight and gets the mixture of the contexts that are known, so the grams of any
texts are scored beside those of the training rows, and scoring a text is a
lookup.  The grams and words that occur most, at most a fixed number, are
broadcast; a text's others are counted and meet their scores in a shuffle join.

Lower-casing of A-Z applies to both scores.  Defined results: a null or empty
text has one token, its end, and is scored as the end byte alone; a null id
counts as held out by crc32 of the empty text; rows are independent; without
training rows every probability is one half a bit.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_buffer, trimmed, word_parts

DEPTH = 5
SUBTREE = 3  # depth below which a subtree is weighted as a whole
END = 0xFF
_LOG_HALF = log(0.5)

#: The end-of-text token among words; no word holds a space.
END_TOKEN = b" "


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


# ------------------------------------------------------------------------ grams


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every byte and of the ends of all rows, and the rows' offsets."""
    n = len(offsets) - 1
    gap = DEPTH + 1
    size = np.diff(offsets)
    padded = np.full(DEPTH + int(size.sum()) + n * gap, END, np.uint8)
    start = DEPTH + offsets[:-1] + np.arange(n) * gap  # between rows: an end and DEPTH bytes before the next start
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    padded[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = lower
    wide = padded.astype(np.int64)
    m = len(padded) - DEPTH
    code = wide[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        code |= wide[DEPTH - d : DEPTH - d + m] << (8 * (DEPTH + 1 - d))
    keep = np.arange(int((size + 1).sum())) + np.repeat(np.arange(n) * DEPTH, size + 1)
    return code[keep], np.concatenate([[0], np.cumsum(size + 1)])


def code_parts(data: np.ndarray, offsets: np.ndarray, limit: int):
    """(first row, last row + 1, codes, offsets among them) of about ``limit`` bytes; the
    codes of a longer row come in several parts."""
    for a, b in slices(offsets, limit):
        part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) <= 2 * limit:
            yield a, b, *gram_codes(part, inner)
            continue
        for start in range(0, len(part), limit):
            before = min(start, DEPTH)
            piece = part[start - before : start + limit]
            code, _ = gram_codes(piece, np.array([0, len(piece)]))
            code = code[before : None if start + limit >= len(part) else -1]
            yield a, b, code, np.array([0, len(code)])


def _count(batches):
    """(kind, gram, word, n, m): of grams (kind 0) and words (kind 1) the counts in
    training rows, which may be 0, and in all rows."""

    def out(grams, words):
        if grams is not None and len(grams[0]):
            k = len(grams[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(grams[0]), pa.nulls(k, pa.binary()), pa.array(grams[1]), pa.array(grams[2])], names=["kind", "gram", "word", "n", "m"])
        if words and words[0]:
            every, out_ = words
            k, m = len(every), np.fromiter(every.values(), np.int64, len(every))
            n = m - np.fromiter(map(out_.__getitem__, every), np.int64, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(list(every), pa.binary()), pa.array(n), pa.array(m)],
                names=["kind", "gram", "word", "n", "m"],
            )

    none = np.zeros(0, np.int64)
    codes, counts, totals, every, held = none, none, none, Counter(), Counter()  # words of all rows, and of those held out
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        train = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for a, b, code, at in code_parts(data, offsets, 1 << 19):
            weight = np.repeat(train[a:b], np.diff(at))
            seen, n = np.unique(code[weight], return_counts=True)
            other, m = np.unique(code[~weight], return_counts=True)
            merged, inverse = np.unique(np.concatenate([codes, seen, other]), return_inverse=True)
            n_of = np.concatenate([counts, n, np.zeros(len(other), np.int64)])
            m_of = np.concatenate([totals, n, m])
            codes, counts, totals = merged, np.bincount(inverse, n_of, len(merged)).astype(np.int64), np.bincount(inverse, m_of, len(merged)).astype(np.int64)
            if len(codes) > 1_000_000:
                yield from out((codes, counts, totals), None)
                codes, counts, totals = none, none, none
        for i, learns in enumerate(train.tolist()):
            for part in word_parts(data[offsets[i] : offsets[i + 1]].tobytes().lower()):
                words = part.split()
                every.update(words)
                if not learns:
                    held.update(words)
            every[END_TOKEN] += 1
            held[END_TOKEN] += not learns
            if len(every) > 150_000:
                yield from out(None, (every, held))
                every, held = Counter(), Counter()
    yield from out((codes, counts, totals), (every, held))


# ------------------------------------------------------------------------- tree


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    top = np.concatenate([n0, n1, n0 + n1])
    values, inverse = np.unique(top, return_inverse=True)
    half = np.array([lgamma(v + 0.5) for v in values])[inverse]
    whole = np.array([lgamma(v + 1.0) for v in values])[inverse]
    k = len(n0)
    return half[:k] + half[k : 2 * k] - whole[2 * k :] - log(pi)


def _bit_nodes(code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every gram its eight nodes at ``depth`` (context and heap index of the
    decided bits) and the bits decided there, shaped (grams, 8)."""
    byte = code & 0xFF
    shift = np.arange(8)
    heap = (1 << shift) | (byte[:, None] >> (8 - shift))
    context = code >> (8 * (DEPTH - depth + 1))
    return (context[:, None] << 8) | heap, (byte[:, None] >> (7 - shift)) & 1


class _Level:
    """The nodes of one depth: counts and estimates."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int) -> None:
        node, bit = _bit_nodes(code, depth)
        self.key, self.of = np.unique(node, return_inverse=True)
        self.of = self.of.reshape(node.shape)
        size = len(self.key)
        weights = np.repeat(n, 8)
        self.n1 = np.bincount(self.of.ravel(), weights * bit.ravel(), size)
        self.n0 = np.bincount(self.of.ravel(), weights, size) - self.n1
        self.estimate = _kt(self.n0, self.n1)
        self.weighted = self.estimate


def _weigh(levels: list[_Level]) -> None:
    """From the deepest level up: log weighted probabilities."""
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        parent = (lower.key >> 16 << 8) | (lower.key & 0xFF)  # drop the oldest context byte
        below = np.bincount(np.searchsorted(upper.key, parent), lower.weighted, len(upper.key))
        upper.weighted = _LOG_HALF + np.logaddexp(upper.estimate, below)


def _arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table[c].combine_chunks()) for c in names]


def _levels(table: pa.Table) -> tuple[np.ndarray, list[_Level]]:
    code, n = _arrays(table, "gram", "n")
    levels = [_Level(code, n.astype(float), d) for d in range(SUBTREE, DEPTH + 1)]
    _weigh(levels)
    return code, levels


def _subtrees(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The top nodes of some whole subtrees, for the levels above."""
    top = _levels(table)[1][0]
    end = np.zeros(len(top.key))  # the subtrees' own weights are taken while scoring
    return pa.table({"node": top.key, "n0": top.n0, "n1": top.n1, "weighted": top.weighted, "ends": end})


def _mixed(batches):
    """Nodes with their children's weighted sum to nodes with their own weighted
    probability and the weight of ending in them."""
    for batch in batches:
        node, n0, n1, below = (np.asarray(batch.column(i)) for i in range(4))
        estimate = _kt(n0, n1) if len(node) else n0
        weighted = _LOG_HALF + np.logaddexp(estimate, below)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weighted), pa.array(np.exp(_LOG_HALF + estimate - weighted))], names=["node", "n0", "n1", "weighted", "ends"])


def _scored(grams: pa.Table, above: pa.Table) -> pa.Table:
    """Log probabilities of some whole subtrees' grams.  above: for every top node
    the weight left for it by its ancestors, and their share of a one."""
    if not grams.num_rows:
        return pa.table({"gram": np.zeros(0, np.int64), "m": np.zeros(0, np.int64), "score": np.zeros(0)})
    code, levels = _levels(grams)
    node, left, ones = _arrays(above, "node", "left", "ones")
    _, bit = _bit_nodes(code, 0)

    def kt(level):
        n1, total = level.n1[level.of], (level.n0 + level.n1)[level.of]
        return np.where(bit == 1, n1 + 0.5, total - n1 + 0.5) / (total + 1.0)

    mixture = kt(levels[-1])
    for level in levels[-2::-1]:
        end = np.exp(_LOG_HALF + level.estimate - level.weighted)[level.of]
        mixture = end * kt(level) + (1 - end) * mixture
    order = np.argsort(node)
    at = order[np.searchsorted(node, levels[0].key, sorter=order)][levels[0].of]
    mixture = np.where(bit == 1, ones[at], 1 - left[at] - ones[at]) + left[at] * mixture
    return pa.table({"gram": code, "m": grams["m"].combine_chunks(), "score": np.log10(mixture).sum(axis=1)})


def gram_scores(grams: DataFrame, group: int = 200_000) -> DataFrame:
    """``grams(gram, n, m)`` to (gram, m, score): the log10 probability of the byte.
    Subtrees are spread over groups of about ``group`` grams."""
    groups = F.lit(max(1, -(-grams.count() // group)))
    bucket = lambda context: F.pmod(F.xxhash64(context), groups)
    keyed = grams.withColumn("bucket", bucket(F.shiftright("gram", 8 * (DEPTH + 1 - SUBTREE))))
    kind = "node long, n0 double, n1 double, weighted double, ends double"
    levels = [materialize(keyed.groupBy("bucket").applyInArrow(_subtrees, kind), "ctw-top")]
    parent = F.shiftright("node", 16) * 256 + F.col("node").bitwiseAND(255)  # drops the oldest context byte
    for _ in range(SUBTREE):
        below = levels[0].groupBy(parent.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        levels.insert(0, materialize(below.mapInArrow(trimmed(_mixed), kind), "ctw-level"))
    down = levels[0].select("node", F.lit(1.0).alias("left"), F.lit(0.0).alias("ones"), "n0", "n1", "ends")
    for level in levels[1:]:
        passed = down.select(
            F.col("node").alias("up"), (F.col("left") * (1 - F.col("ends"))).alias("left"),
            (F.col("ones") + F.col("left") * F.col("ends") * (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("ones"),
        )
        down = level.withColumn("up", parent).join(passed, "up").select("node", "left", "ones", "n0", "n1", "ends")
    above = down.select("node", "left", "ones", bucket(F.shiftright("node", 8)).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_scored, "gram long, m long, score double")


# ---------------------------------------------------------------------- scoring


class Lookup:
    """An open-addressing table from codes to scores, in arrays."""

    _spread = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray, scores: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)  # codes are not negative
        self.values = np.zeros(1 << self.bits)
        slot, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = codes[left[free]]  # of several for a slot, the last stays
            won = self.keys[slot] == codes[left]
            self.values[slot[won]] = scores[left[won]]
            slot, left = (slot[~won] + 1) & (len(self.keys) - 1), left[~won]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * self._spread) >> np.uint64(64 - self.bits)).view(np.int64)

    def add(self, codes: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Adds the scores of the codes that the table holds; the places of others."""
        slot = self._slot(codes)
        keys = self.keys.take(slot)
        hit = keys == codes
        to += np.where(hit, self.values.take(slot), 0.0)
        left = np.flatnonzero(~hit)
        slot, keys = slot[left], keys[left]
        absent = [left[keys == -1]]
        left, slot = left[keys != -1], slot[keys != -1]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            keys = self.keys.take(slot)
            hit = keys == codes[left]
            to[left[hit]] += self.values.take(slot[hit])
            absent.append(left[keys == -1])
            go = ~hit & (keys != -1)
            left, slot = left[go], slot[go]
        return np.concatenate(absent)


class Model:
    """Trained counts: ``grams(gram, n, m)``, ``words(word, n, m)`` and totals.  The tables
    hold the grams and words of all rows of the training call, with n = 0 where no
    training row has them."""

    def __init__(self, source: DataFrame, grams: DataFrame, words: DataFrame, tokens: int, distinct: int) -> None:
        self.source, self.grams, self.words, self.tokens, self.distinct = source, grams, words, tokens, distinct

    def scores(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(gram, m, score) of all grams of ``docs`` at least."""
        grams = self.grams
        if docs is not self.source:  # the grams of other texts, seen in training or not
            counted = docs.select(F.col(text_col).alias("text"), F.lit(True).alias("out")).mapInArrow(trimmed(_count), COUNTED)
            more = counted.where("kind = 0").select("gram", "n", "m")
            grams = materialize(grams.select("gram", "n", F.lit(0).cast("long").alias("m")).unionByName(more).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-more-grams")
        return materialize(gram_scores(grams), "lm-scores")


COUNTED = "kind int, gram long, word binary, n long, m long"


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    source = docs.select(F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("out"))
    counted = materialize(source.mapInArrow(trimmed(_count), COUNTED), "lm-partial")
    grams = materialize(counted.where("kind = 0").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-grams")
    words = materialize(counted.where("kind = 1").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    return Model(docs, grams, words, int(total[0]), int(total[1]))


def most_frequent(table: DataFrame, limit: int) -> Column:
    """A condition on ``m`` that at most ``limit`` rows meet: those above a count, found
    from a histogram of a few hundred places."""
    place = F.floor(F.log2(F.greatest("m", F.lit(1)).cast("double")) * 16)
    held, least = 0, float("inf")
    for row in table.groupBy(place.alias("place")).agg(F.count("*").alias("c"), F.min("m").alias("least")).orderBy(F.desc("place")).collect():
        held += row["c"]
        if held > limit:
            break
        least = row["least"]
    return F.col("m") >= F.lit(least)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", frequent_grams: int = 1 << 20, frequent: int = 1 << 18) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte) of any texts.  frequent_grams and frequent bound the entries that
    are broadcast."""
    context = docs.sparkSession.sparkContext
    scores, words = model.scores(docs, text_col), model.words
    often, common = most_frequent(scores, frequent_grams), most_frequent(words, frequent)
    rows = scores.where(often).select("gram", "score").toArrow()
    table = context.broadcast(Lookup(*_arrays(rows, "gram", "score")))
    rows = words.where(common).select("word", "n").toArrow()
    known = context.broadcast((rows["word"].to_pylist(), rows["n"].to_numpy().astype(float)))
    del rows
    floor = 0.1 * (model.distinct + 1) + model.tokens
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("out"))
    head = source.select("id").schema["id"].dataType.simpleString()
    # a row of kind 0 for each text; its rare words (1) and grams (2) with their numbers
    names = ["kind", "row", "id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "word", "gram", "k"]
    types = [pa.int32(), pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    schema = f"kind int, row long, id {head}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, word binary, gram long, k long"

    def score(batches):
        from pyspark import TaskContext

        frequent_words, counts = known.value
        values = np.log10((counts + 0.1) / floor)
        place, unknown, lookup = {w: i for i, w in enumerate(frequent_words)}, repeat(-1), table.value
        learned = counts > 0
        first = TaskContext.get().partitionId() << 36

        def out(ids_type, n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t or ids_type) for c, t in zip(names, types)], names=names)

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids, outs = batch.column(0), batch.column(2)
            rows = batch.num_rows
            number = first + np.arange(rows)
            first += rows
            total = np.zeros(rows)
            for a, b, code, at in code_parts(data, offsets, 1 << 19):
                found = np.zeros(len(code))
                absent = lookup.add(code, found)
                total[a:b] += np.add.reduceat(found, at[:-1])
                if len(absent):
                    row = a + np.searchsorted(at, absent, "right") - 1
                    pairs, k = np.unique(np.stack([row, code[absent]]), axis=1, return_counts=True)
                    yield out(ids.type, len(k), kind=np.full(len(k), 2), row=number[pairs[0]], gram=pairs[1], k=k)
            n_tokens, n_known, base = np.ones(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            end = place.get(END_TOKEN)
            rare: list[tuple[int, bytes, int]] = []
            for i in range(rows):
                if end is None:
                    rare.append((number[i], END_TOKEN, 1))
                else:
                    n_known[i], base[i] = learned[end], values[end]
                for part in word_parts(data[offsets[i] : offsets[i + 1]].tobytes().lower()):
                    found_words = part.split()
                    seen = np.fromiter(map(place.get, found_words, unknown), np.int64, len(found_words))
                    hit = seen >= 0
                    n_tokens[i] += len(found_words)
                    n_known[i] += int(learned[seen[hit]].sum())
                    base[i] += values[seen[hit]].sum()
                    rare += [(number[i], w, k) for w, k in Counter(found_words[j] for j in np.flatnonzero(~hit).tolist()).items()]
                if rare and (len(rare) > 100_000 or i + 1 == rows):
                    row, word, k = zip(*rare)
                    yield out(ids.type, len(k), kind=np.full(len(k), 1), row=row, word=word, k=k)
                    rare = []
            yield out(ids.type, rows, kind=np.zeros(rows, np.int32), row=number, id=ids, held_out=outs, n_tokens=n_tokens, known=n_known, base=base, score=total, n_bytes=np.diff(offsets))

    scored = materialize(source.mapInArrow(trimmed(score), schema), "lm-scored")
    c = F.coalesce("n", F.lit(0))
    rare_words = scored.where("kind = 1").select("row", "word", "k").join(words.where(~common).select("word", "n"), "word", "left")
    rare_words = rare_words.select("row", (F.col("k") * F.log10((c + 0.1) / F.lit(floor))).alias("base"), F.when(c > 0, F.col("k")).otherwise(0).alias("known"), F.lit(0.0).alias("score"))
    rare_grams = scored.where("kind = 2").select("row", "gram", "k").join(scores.where(~often).select("gram", "score"), "gram")
    rare_grams = rare_grams.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("k") * F.col("score")).alias("score"))
    rest = rare_words.unionByName(rare_grams).groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"), F.sum("score").alias("more_score"))
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    done = scored.where("kind = 0").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", plus("known", "more_known", 0).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base", 0.0).alias("base_score"), plus("score", "more_score", 0.0).alias("score"), "n_bytes",
    )
    return done.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1)))
