"""Registered queries against their own SQL, on small tables where a cut or an odd row shows."""

import duckdb

import __spark_entry__
from trailmark.operators import dense


def both(spark, folder, name, **tables):
    """The rows by the query and by its SQL, sorted, as text: -0.0 and NaN are told apart."""
    base = duckdb.connect()
    for table, rows in tables.items():
        kind, values = rows
        spark.createDataFrame(values, kind).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = __spark_entry__.queries()[name](spark, str(folder))
    wanted = base.execute(__spark_entry__.oracle_sql()[name])
    assert found.columns == [c[0] for c in wanted.description]
    return sorted(repr(tuple(r)) for r in found.collect()), sorted(map(repr, wanted.fetchall()))


def test_mean_pool_is_its_sql_for_odd_vectors(spark, tmp_path):
    plain = [float(i % 7 - 3) for i in range(64)]
    rows = [None, [], [0.0] * 64, [1e-20] * 64, [-1e-9] + [1.0] * 63, [float("inf")] + plain[1:], [float("nan")] + plain[1:], [-0.0] * 48 + [1.0] * 16, plain, plain * 2, plain[:48]]
    got, wanted = both(spark, tmp_path, "mean_pool", embeddings=("vec_id long, embedding array<float>, label int", [(i, v, 0) for i, v in enumerate(rows)]))
    assert got == wanted and len(got) == len(rows)


def lexical_tables():
    """Five words of one question, of which ``echo`` is the most frequent; documents 5 to 16 hold
    no other of them."""
    texts = [f"title {w}\n{w} echo" for w in ("alpha", "bravo", "charlie", "delta", "écho")] + ["other\necho and more"] * 12 + ["none\nnothing here"] * 40
    return {
        "documents": ("doc_id long, text string", list(enumerate(texts))),
        "benchmark": ("item_id long, text string", [(0, "alpha bravo charlie delta echo"), (1, "echo"), (2, "unknown")]),
    }


def test_folded_search_takes_all_words(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "bm25_folded", **lexical_tables())
    assert got == wanted and any(r.startswith("(0, 5, ") for r in got)


def test_search_without_a_stored_index_takes_all_words(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "bm25_full_index", **lexical_tables())
    assert got == wanted and any(r.startswith("(0, 5, ") for r in got)


def id_tables():
    """Ids with a choice at most digits: an id takes up to six choices."""
    return {"documents": ("doc_id long, text string", [(7919 * i % 100003, "x") for i in range(300)]), "benchmark": ("item_id long, text string", [(q, "x") for q in range(12)])}


def test_greedy_decoding_goes_on_to_the_end(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "gmr_greedy", **id_tables())
    ended = [r.split("'")[1].split(",") for r in got]
    assert got == wanted and len(got) == 12 and all(r[-1] == "11" for r in ended) and max(r.count("10") for r in ended) > 1


def test_rankings_by_decoding_hold_ids_of_many_choices(spark, tmp_path):
    """Every digit is a choice, and no id ends before the ninth."""
    ids = ["".join("12"[i >> b & 1] for b in range(9)) for i in range(512)]
    got, wanted = both(spark, tmp_path, "gmr_ranked", documents=("doc_id long, text string", [(int(i), "x") for i in ids]), benchmark=("item_id long, text string", [(q, "x") for q in range(8)]))
    assert got == wanted and {r.split(",")[0] for r in got} == {f"({q}" for q in range(8)}


def test_reasoning_ranks_all_that_shares_a_word(spark, tmp_path):
    """Seventeen passages share a word with the first question, twelve of them the fifth alone."""
    got, wanted = both(spark, tmp_path, "ircot_stub", **lexical_tables())
    first = {int(r.split(",")[1]) for r in got if r.startswith("(0, ")}
    assert got == wanted and first >= {0, 1, 2, 3, *range(5, 17)}


def test_fusion_of_whole_lists_leaves_nothing_out(spark):
    lists = [spark.range(900).selectExpr("id % 3 AS query_id", "id AS doc_id", f"row_number() OVER (PARTITION BY id % 3 ORDER BY hash(id, {i})) AS rank").where(f"query_id < {3 - i}") for i in range(2)]
    want = sorted(dense.rrf_fuse(*lists, constant=10, depth=5).collect())
    assert sorted(dense.rrf_fuse_whole(*lists, constant=10, depth=5).collect()) == want and len(want) == 15
    assert sorted(dense.rrf_fuse_whole(*[x.where("rank < 4") for x in lists], depth=7).collect()) == sorted(dense.rrf_fuse(*[x.where("rank < 4") for x in lists], depth=7).collect())


def test_hybrid_ranks_whole_lists(spark, tmp_path, monkeypatch):
    """A passage without a question's rarer words stands in the list by words, too."""
    monkeypatch.setattr(dense, "PAIRS", 16)  # several tiles
    got, wanted = both(spark, tmp_path, "hybrid_dense_bm25", **lexical_tables())
    assert got == wanted and {"doc/" + str(i) for i in range(57)} == {r.split("'")[1] for r in got if r.startswith("(0, ")}
