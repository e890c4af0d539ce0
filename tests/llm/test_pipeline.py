"""The pipeline: its stages against plain versions, row by row."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import components_of, plain_sets
from tests.llm.test_scans import plain_features
from trailmark.llm import mixing, packing, secrets
from trailmark.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(rng.randint(3, 90))]
        if i % 10 == 0:
            words.append("token=abcdefghijklmnop")
        if i % 13 == 0:
            words = words[:3] * 12
        text = " ".join(words)
        if i % 7 == 6:
            text = rows[-1][1]
        if i % 11 == 5:
            text = rows[-1][1].replace("a", "z", 1)
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["big", "big", "small"]), len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "big", 0)]
    return rows


def test_stages_against_plain_versions(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "secret scans", "mixing sources", "best-fit packing"]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality rules"](spark, docs, "")
    kept = []
    for row in rows:
        n, chars, symbols, dup, repeat = plain_features(row[1])
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (row[1] or "").split("\n"))
        if not (n < 10 or 100 * repeat > 20 * n or chars < 2 * n or chars > 25 * n or symbols * 10 > n * 4 or dup * 10 > lines * 4):
            kept.append(row)
    assert sorted(map(tuple, good.collect())) == sorted(kept) and good.schema == docs.schema

    single = stages["near duplicates"](spark, good, "")
    sets = [plain_sets(row[1], 5) for row in kept]
    links = [(i, j) for i in range(len(kept)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components_of(len(kept), links)
    kept = [row for i, row in enumerate(kept) if root[i] == i]
    assert len(kept) < len(root)
    assert sorted(map(tuple, single.collect())) == sorted(kept)

    clean = stages["secret scans"](spark, single, "")
    changed = [(i, t.replace("token=abcdefghijklmnop", "[secret]"), lang, source, len(t.replace("token=abcdefghijklmnop", "[secret]"))) for i, t, lang, source, _ in kept]
    assert changed != kept
    assert sorted(map(tuple, clean.collect())) == sorted(changed)

    mixed = stages["mixing sources"](spark, clean, "")
    assert mixed.columns == docs.columns
    marked = mixing.mix_sources(clean).collect()
    drawn = {r["doc_id"] for r in marked if r["__tm_sampled"]}
    assert {r["doc_id"] for r in mixed.collect()} == drawn and 0 < len(drawn) <= len(changed)

    packed = stages["best-fit packing"](spark, mixed, "").collect()
    encode = packing.Encoder(tokenizer_path())
    for row in changed:
        if row[0] in drawn:
            ids = np.array([*encode(row[1]), 2], "<u4")
            (piece,) = [r for r in packed if r["doc_id"] == row[0]]
            assert (piece["length"], piece["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert {r["doc_id"] for r in packed} == drawn


def test_empty_documents_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_survive(spark):
    docs = spark.createDataFrame([r for r in documents() if r[1]], COLUMNS).withColumn("row", F.lit(1)).withColumn("label", F.lit("x")).withColumn("__tm_row", F.lit(7)).withColumn("a.b", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), "row", "label", "__tm_row", "a.b"], name
    assert docs.where("label <> 'x' or __tm_row <> 7 or `a.b` <> 'y'").count() == 0


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_every_rule_compiles_to_its_regex(rule):
    rng = random.Random(rule.kind)
    scanner = secrets.compiled((rule,))
    alphabet = "token=:\"' AKIAghp_xoxb-AIzaeyJ.-----BEGIN PRIVATE KEY0123456789abcdef"
    for _ in range(40):
        text = "".join(rng.choice(alphabet) for _ in range(80)).encode()
        states = scanner.all.states(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        ends = {i + 1 for i in np.flatnonzero(scanner.all.accepts[states]).tolist()}
        regex = re.compile(rule.pattern.encode())
        assert ends == {e for s in range(len(text)) for e in range(s + 1, len(text) + 1) if regex.fullmatch(text, s, e)}
