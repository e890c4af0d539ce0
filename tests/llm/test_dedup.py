"""Near-duplicates, windows, suffixes, scores and neighbours against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import exp, lgamma, log, log10, pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import common, lm, near_dups, neighbours, suffixes, window_index

DOCS = "doc_id long, text string"


def corpus(seed, n=40, words="abcdefgh", length=60):
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(length // 2))
    out = [None, "", " ", "one", "Two words", "two WORDS"]
    for _ in range(n):
        kind = rng.random()
        base = rng.choice(out[6:]) if len(out) > 8 else ""
        if kind < 0.25 and base:
            out.append(base)
        elif kind < 0.5 and base:
            w = base.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words) + str(rng.randint(0, 99))
            out.append(" ".join(w))
        else:
            text = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(5, length)))
            out.append(text + "\n" + passage if kind > 0.8 else text)
    return list(enumerate(out))


def components_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    sets = [plain_sets(t, 3) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    expected = components_of(len(rows), links)
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs, k=3, similarity=85).collect()}
    for i in range(len(rows)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), expected[i], expected[i] == i)


def test_crossing_pairs_lose_no_link(spark):
    """A chain of near copies: no two leaders are similar, so links cross components."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
    sets = [plain_sets(t, 3) for _, t in rows]
    links = [(i, j) for i in range(30) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    nodes = spark.createDataFrame([(i, i) for i in range(30)], "node long, label long")
    texts = spark.createDataFrame(rows, "id long, text string")
    pairs = near_dups.crossing_pairs(nodes, texts, 3, 85)
    assert {(r["a"], r["b"]) for r in near_dups.verified(pairs, texts, 3, 85).collect()} == {(j, i) for i, j in links}


def test_near_duplicates_edge_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "other words here"), (7, "A B C D E F"), (8, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = near_dups.drop_near_duplicates(docs, k=3)
    assert sorted(kept.collect(), key=str) == sorted([(1, "a b c d e f"), (None, "other words here"), (8, None)], key=str)
    assert near_dups.near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_without_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near, other, far = " ".join([*base[:-1], "new"]), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(None, " ".join(base)), (None, " ".join(base)), (None, " ".join(base).upper()), (None, near), (None, other), (5, other + " end"), (None, far), (None, None), (None, ""), (None, ""), (9, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = sorted(map(tuple, near_dups.drop_near_duplicates(docs).collect()), key=str)
    group = [r for r in kept if r[1] in (" ".join(base), " ".join(base).upper(), near)]
    assert len(group) == 1 and group[0][0] is None
    assert sorted((r for r in kept if r not in group), key=str) == sorted([(5, other + " end"), (None, far), (None, None), (None, ""), (None, ""), (9, None)], key=str)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for similarity in (0.3, 0.85):
        errors = []
        for _ in range(40):
            n = int(rng.integers(50, 400))
            shared = int(2 * n * similarity / (1 + similarity))
            u = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
            s = near_dups.super_minhash([np.unique(u[:n]), np.unique(u[n - shared :])])
            errors.append((s[0] == s[1]).mean() - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) < 1.05 * (similarity * (1 - similarity) / near_dups.SIGNATURE) ** 0.5
    for similarity in (80, 85, 95):
        bands, rows = near_dups.band_shape(similarity)
        assert (1 - (similarity / 100) ** rows) ** bands <= 1e-6


def test_signatures_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 3, 900, 40, 0, 77, 500)]
    assert (near_dups.signatures(sets, limit=64) == near_dups.super_minhash(sets)).all()


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-20_000], "end"])), (3, " " * 1_000_000), (4, "x" * 1_000_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (399_996, 1), 2: (379_997, 1), 3: (0, 3), 4: (1, 4)}


@pytest.mark.parametrize("few", [0, 20, 10**6])
def test_components_of_chains_and_stars(spark, few):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    root = components_of(2101, [(a, b) for a, b in edges])
    for a, b in edges:
        if a != b:
            assert got[a] == got[b]
    assert len(set(got.values())) == len({root[x] for x in got})
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_windows(rows, width):
    first = {}
    words = {}
    for i, t in rows:
        w = words[i] = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("batches,most", [(1, 1000), (10, 1000), (2, 1)])
def test_windows(spark, batches, most, monkeypatch):
    rows = corpus(11, n=50, length=80)
    start = window_index.FingerprintIndex.__init__
    monkeypatch.setattr(window_index.FingerprintIndex, "__init__", lambda self, w, g: start(self, w, g, 2, most))
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).repartition(3)
    got = window_index.dedup_substrings(docs, width=10, gram=4, batches=batches).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == plain_windows(rows, 10)


def test_a_stored_index_goes_on(spark, tmp_path):
    rows = corpus(14, n=40, length=80)
    docs = spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("id"), common.row_key().alias("row"), "text")
    old, new = docs.where("id < 30"), docs.where("id >= 30")
    index = window_index.FingerprintIndex(10, 4)
    first = common.materialize(index.add(old), "t")
    index.save(str(tmp_path / "index"))
    again = window_index.FingerprintIndex.load(spark, str(tmp_path / "index"), old)
    ranges = first.unionByName(again.add(new))
    got = window_index.remove_ranges(docs, ranges, 10).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == plain_windows(rows, 10)


def test_only_holders_of_open_owners_are_read_again(spark):
    """New documents that share nothing, or only whole stretches, with the history cost no reading of it."""
    words = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + i).randint(0, 10**9)}" for i in range(n))
    old = [(i, words(i, 200)) for i in range(20)]
    index = window_index.FingerprintIndex(10, 4)
    frame = lambda rows: spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("id"), common.row_key().alias("row"), "text")
    index.add(frame(old)).count()
    seen = []
    holders = window_index.FingerprintIndex.holders
    index.holders = lambda firsts: seen.append(holders(index, firsts)) or seen[-1]
    index.add(frame([(100, words(77, 200)), (101, old[3][1])])).count()
    assert seen[-1].count() == 0
    index.add(frame([(200, "new " + old[5][1])])).count()
    assert [r["id"] for r in seen[-1].select("id").collect()] == [5]


def test_windows_of_long_texts(spark):
    text = " ".join(map(str, range(300_000)))
    rows = [(1, text), (2, text + " end"), (3, " " * 1_000_000), (4, "x" * 6_000_000)]
    got = window_index.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got} == {1: (300_000, 0), 2: (300_001, 300_000), 3: (0, 0), 4: (1, 0)}


def test_windows_edge_rows(spark):
    text = " ".join(map(str, range(60)))
    rows = [(1, text), (1, text), (2, text + " more"), (None, text), (3, None), (4, " ".join(map(str, range(30)))), (0, "x")]
    got = window_index.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("0", 0), ("1", 0), ("1", 0), ("2", 60), ("3", 0), ("4", 0), ("None", 0)]
    assert window_index.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0


def plain_strings(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most", [20_000, 1])
def test_strings(spark, most):
    rows = corpus(21, n=50, words="abé", length=60) + [(900, "ab" * 100), (901, "z" * 80), (901, "z" * 80)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("h", F.lit("clash")).repartition(3)
    got = suffixes.dedup_suffixes(docs, width=40, gram=10, most=most).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((i, *x) for (i, _), x in zip(rows, plain_strings(rows, 40)))
    assert suffixes.dedup_suffixes(docs.where("false")).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(97, 99, int(rng.integers(1, 30))).astype(np.uint8) for _ in range(200)]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    at = np.array([int(rng.integers(0, len(p))) for p in pieces])
    group = np.sort(rng.integers(0, 9, 200))
    s = suffixes.Suffixes(group, np.concatenate(pieces), edges[:-1], edges[1:], at)
    key = lambda i: (group[i], pieces[i][at[i] :].tobytes(), i)
    assert s.sort().tolist() == sorted(range(200), key=key)


def test_collided_chunk_falls_back(monkeypatch):
    """With a hash that always collides the result is still that of the strings."""
    data = np.frombuffer(b"xxabcdefyyabcdefzzabcdxx", np.uint8)
    edges, at, n = np.array([0, 8, 16, 24]), np.array([2, 2, 2]), np.array([5, 5, 5])
    plain = suffixes._plain(np.zeros(3, int), data, edges, n, 4)
    monkeypatch.setattr(suffixes, "range_hash", lambda sums, a, b, *_: np.zeros(len(a), np.uint64))
    got = suffixes.repeated_strings(np.zeros(3, int), data, edges, at, n, 4)
    assert sorted(zip(*map(list, got))) == sorted(zip(*map(list, plain)))


def test_scores_are_those_of_the_tree(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("aB é\n") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "Q" * 300)]
    depth = lm.DEPTH
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    low = lambda t: (t or "").encode().lower()
    counts, words = defaultdict(lambda: [0, 0]), Counter()

    def steps(raw):
        raw = b"\xff" * depth + raw + b"\xff"
        for p in range(depth, len(raw)):
            heap = 1
            for j in range(8):
                bit = (raw[p] >> (7 - j)) & 1
                yield [(raw[p - d : p], heap) for d in range(depth + 1)], bit
                heap = heap * 2 + bit

    for i, t in rows:
        if not out[i]:
            words.update([*low(t).split(), b" "])
            for path, bit in steps(low(t)):
                for node in path:
                    counts[node][bit] += 1
    kt = lambda n: lgamma(n[0] + 0.5) + lgamma(n[1] + 0.5) - lgamma(sum(n) + 1) - log(pi)
    weighted, below = {}, defaultdict(float)
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(counts[node])
        weighted[node] = own if len(node[0]) == depth else log(0.5) + np.logaddexp(own, below[node])
        if node[0]:
            below[(node[0][1:], node[1])] += weighted[node]

    def score(t):
        total = 0.0
        for path, bit in steps(low(t)):
            p = None
            for node in reversed(path):
                n = counts.get(node, [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                w = exp(log(0.5) + kt(n) - weighted[node]) if node in weighted else 0.5
                p = own if p is None else w * own + (1 - w) * p
            total += log10(p)
        return total

    total, distinct = sum(words.values()), len(words)
    docs = spark.createDataFrame(rows, DOCS).withColumn("gram", F.lit("clash")).repartition(3)
    model = lm.train(docs)
    # of the training table, and of texts that the model has not seen: new bytes, new contexts, new words
    others = [(i, t) for i, t in [*rows[:9], (70, "never seen é"), (71, "QQ aB xyz " * 9), (72, "\u4e2d\u6587"), (73, "z" * 25), (74, "z" * 25), (75, None)]]
    assert len({r[0] for r in others}) == len(others)
    out |= {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in others}
    more = spark.createDataFrame(others, DOCS).repartition(2)
    for table, of, grams, frequent in ((docs, rows, 10**6, 1000), (docs, rows, 300, 5), (more, others, 10**6, 1000), (more, others, 0, 0)):
        got = {r["doc_id"]: r for r in lm.score_texts(table, model, frequent_grams=grams, frequent=frequent).collect()}
        assert len(got) == len(of)
        for i, t in of:
            tokens = [*low(t).split(), b" "]
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(tokens), sum(words[w] > 0 for w in tokens), total)
            assert r["base_score"] == pytest.approx(sum(log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens))
            assert r["score"] == pytest.approx(score(t), rel=1e-9)


def test_probabilities_after_a_context_sum_to_one(spark):
    rng = random.Random(16)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abc \n") for _ in range(60))) for i in range(30)], DOCS)
    model = lm.train(docs)
    contexts = [b"abcab", b"zzzab", b"\xff\xff\xff\xffa", b"\xe4\xb8\xad\xe6\x96", b"qqqqq"]
    codes = [sum(b << (8 * (j + 1)) for j, b in enumerate(c)) | x for c in contexts for x in range(256)]  # the most recent byte highest
    grams = model.grams.unionByName(spark.createDataFrame([(c, 0, 0) for c in codes], "gram long, n long, m long")).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    got = {r["gram"]: r["score"] for r in lm.gram_scores(grams, group=100).collect()}
    for i in range(len(contexts)):
        assert sum(10 ** got[c] for c in codes[256 * i : 256 * i + 256]) == pytest.approx(1, abs=1e-9)


def test_most_frequent_is_bounded(spark):
    table = spark.createDataFrame([(i, 1 + i * i // 7) for i in range(1000)], "gram long, m long")
    for limit in (0, 1, 10, 500, 1000, 5000):
        n = table.where(lm.most_frequent(table, limit)).count()
        assert n <= limit and n >= min(limit, 1000) * 0.5 - 5


def test_scores_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert lm.score_texts(docs, lm.train(docs)).count() == 0


def vectors(seed, n, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, d))
    return centres[rng.integers(0, 10, n)] + 0.4 * rng.normal(size=(n, d))


def test_neighbours_reach_recall(spark):
    x = vectors(1, 6000)
    x[100:400] = x[100]  # many equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(dict)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, block=700).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -9
        order = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        ids = [got[q][k][0] for k in range(1, 6)]
        found += len(set(order) & set(ids))
        total += 5
        assert [got[q][k][1] for k in range(1, 6)] == pytest.approx(s[ids].tolist())
    assert found / total >= 0.9
    assert [got[150][k][0] for k in range(1, 6)] == [100, 101, 102, 103, 104]  # ties to the smaller id


def test_leaves_below_parts_reach_recall(spark):
    """More parts than one partition may have: parts of parts."""
    x = vectors(3, 5000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    leaves = neighbours.fit_leaves(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), sample=1000, most_parts=8)
    assert leaves.top.parts == 8 and leaves.count > 40 and len(leaves.below) == 8
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, sample=1000, most_parts=8).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in range(0, 5000, 50):
        s = unit @ unit[q]
        s[q] = -9
        found += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert found / 500 >= 0.9
    query, leaf = leaves.route(unit[::50], None)
    assert len(leaf) < 0.6 * 100 * leaves.count


def test_small_tables_are_partitioned_too(spark):
    x = vectors(4, 400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    leaves = neighbours.fit_leaves(df)
    assert leaves.count == 20 and 1 <= leaves.top.visits < 20


def test_repeated_candidates_are_listed_each(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 600)]
    query = rng.normal(size=8).tolist()
    rows += [(0, query), (7, query), (7, query), (9, [2 * x for x in query]), (50, rng.normal(size=8).tolist())] + [rows[29]] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, visits=10**6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [v for _, v, _ in sorted(got[0])[:3]] == [7, 7, 9]
    for q, v in ((i, x) for i, x in rows if i % 50 == 0):
        cos = lambda x: sum(a * b for a, b in zip(v, x)) / (sum(a * a for a in v) * sum(b * b for b in x)) ** 0.5
        want = sorted((-round(cos(x), 12), i) for i, x in rows if i != q)[:5]
        mine = sorted(got[q]) if q != 50 else sorted(got[q])[:10]
        if q != 50:  # two rows have this id
            assert [(-round(s, 12), i) for _, i, s in mine] == want


def test_query_vectors_go_once_to_a_shelf():
    shelf, slots = neighbours._shelves(np.array([3, 4, 5, 0, 30, 1]), 10)
    assert shelf.tolist() == [0, 0, 1, 1, 2, 3] and slots.tolist() == [1, 1, 3, 1]


def test_neighbours_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (50, [1.0, 0.0]), (50, [2.0, 0.0]), (100, None), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 50), (0, 2, 50), (0, 3, 1), (50, 1, 0), (50, 1, 0), (50, 2, 1), (50, 2, 1)]  # every row counts
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_partition_is_balanced():
    x = vectors(2, 2000)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.neighbour_graph(unit, 10)
    label = neighbours.balanced_partition(unit, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 1.1 * 2000 / 8 + 1
    assert (label[graph] == label[:, None]).mean() > 0.5


def test_long_texts_come_in_parts(spark, monkeypatch):
    """Parts of long texts give what whole texts give."""
    rng = np.random.default_rng(12)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    data, offsets = np.concatenate([raw, raw[:900], raw[:30]]), np.array([0, 5000, 5900, 5930])
    whole, at = lm.gram_codes(data, offsets)
    for limit in (7, 100, 10_000):
        total = defaultdict(list)
        for a, b, code, places in lm.code_parts(data, offsets, limit):
            for row, (x, y) in enumerate(zip(places, places[1:])):
                total[a + row] += code[x:y].tolist()
        assert [total[i] for i in range(3)] == [whole[at[i] : at[i + 1]].tolist() for i in range(3)]
    text = b"ab  cd\n" * 50 + b"e" * 99
    assert [w for part in lm.word_parts(text, 10) for w in part.split()] == text.split()
    strings = lambda size: {(int(r), int(lo - inner[i] + place), int(hi - lo)) for part, inner, numbers, place in _parts(size) for _, lo, hi, i in zip(*suffixes._owners(part, inner, 40, 10)[2]) for r in [numbers[i]]}

    def _parts(size):
        monkeypatch.setattr(suffixes, "SLICE", size)
        return list(suffixes._parts(data, offsets, 40))

    starts = lambda found: {(r, s + k) for r, s, n in found for k in range(n + 1)}
    assert starts(strings(300)) == starts(strings(1 << 20)) == {(r, s) for r, n in enumerate(np.diff(offsets)) for s in range(n - 39)}


@pytest.mark.parametrize("name,kind", [("n_words", "string"), ("doc_id", "decimal(20,0)"), ("kept", "long")])
def test_windows_with_ids_of_any_type_and_name(spark, name, kind):
    rows = corpus(11, n=40, length=80)
    docs = spark.createDataFrame(rows, DOCS).select(F.format_string("%05d", "doc_id").cast(kind).alias(name), "text").repartition(3)
    got = window_index.dedup_substrings(docs, id_col=name, width=10, gram=4, batches=3).collect()
    words = "n_words_" if name == "n_words" else "n_words"
    assert {int(r[name]): (r[words], r["n_removed"], r["kept_sha256"]) for r in got} == plain_windows(rows, 10)


@pytest.mark.parametrize("name,kind", [("n_shingles", "string"), ("row", "long")])
def test_near_duplicates_with_ids_of_any_type_and_name(spark, name, kind):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, DOCS).select(F.format_string("%05d", "doc_id").cast(kind).alias(name), "text").repartition(3)
    plain = near_dups.near_duplicates(spark.createDataFrame(rows, DOCS), k=3, similarity=85).collect()
    got = near_dups.near_duplicates(docs, name, k=3, similarity=85)
    assert dict(got.dtypes)["component_id"] == dict(got.dtypes)[name] == {"long": "bigint"}.get(kind, kind)
    size = "n_shingles_" if name == "n_shingles" else "n_shingles"
    assert {int(r[name]): (r[size], int(r["component_id"]), r["kept"]) for r in got.collect()} == {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in plain}
    left = near_dups.drop_near_duplicates(docs, name, k=3, similarity=85)
    assert left.columns == docs.columns and sorted(int(r[name]) for r in left.collect()) == sorted(r["doc_id"] for r in plain if r["kept"])


def test_null_ids_of_another_type(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([("b", text), ("a", text + " more"), (None, text), ("c", None)], "doc_id string, text string")
    got = window_index.dedup_substrings(docs).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {"a": 0, "b": 60, "c": 0, None: 0}
    assert {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c", None: "a"}
    assert window_index.dedup_substrings(docs.where("false")).count() == near_dups.near_duplicates(docs.where("false")).count() == 0


def test_strings_with_an_id_named_like_a_result(spark):
    rows = corpus(5, n=20, length=60)
    docs = spark.createDataFrame(rows, DOCS)
    got = suffixes.dedup_suffixes(docs.withColumnRenamed("doc_id", "n_bytes"), "n_bytes", width=30, gram=8)
    assert got.columns[:2] == ["n_bytes", "n_bytes_"]
    plain = suffixes.dedup_suffixes(docs, width=30, gram=8)
    assert sorted(map(tuple, got.drop("kept").collect())) == sorted(map(tuple, plain.drop("kept").collect()))


def test_the_scan_for_holders_asks_for_ranges_of_ids(spark, tmp_path):
    """Holders at two ends of the history: two ranges reach the scan."""
    rows = [(i, " ".join(f"w{random.Random(i * 1000 + j).randint(0, 10**9)}" for j in range(60))) for i in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("id"), common.row_key().alias("row"), "text")
    frame(rows).write.parquet(str(tmp_path / "old"))
    index = window_index.FingerprintIndex(10, 4)
    index.add(spark.read.parquet(str(tmp_path / "old"))).count()
    seen = []
    holders = window_index.FingerprintIndex.holders
    index.holders = lambda firsts: seen.append(holders(index, firsts)) or seen[-1]
    index.add(frame([(100, "new " + rows[2][1]), (101, "new " + rows[47][1])])).count()
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(id,2),LessThanOrEqual(id,2)),And(GreaterThanOrEqual(id,47)," in plan  # the plan's text is cut there
    assert sorted(r["id"] for r in seen[-1].select("id").collect()) == [2, 47]


def test_ranges_of_extreme_ids(spark):
    ids = spark.createDataFrame([(-(1 << 63),), (0,), ((1 << 63) - 1,)], "id long")
    assert ids.where(window_index._in_spans(ids, -(1 << 63), (1 << 63) - 1)).count() == 3
    assert ids.where(window_index._in_spans(ids, None, None)).count() == 0
