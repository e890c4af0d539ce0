"""Secrets, quality, packing, mixing and url filters against plain versions."""

import decimal
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import mixing, packing, quality, secrets, urls
from trailmark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_spans(x):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(x) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, b, k in sorted(out)]


PIECES = ["password", "Token", "secret", "api_key", "APIKEY", ":", "=", " ", '"', "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "x", "é", "=abc", "a.b-c", "\n", "deadbeef", "ABCD1234"]


@pytest.mark.parametrize("lane", [7, 2048])
def test_secrets_match_plain_regexes(lane, monkeypatch):
    scanner, run = secrets.compiled(secrets.BASE_RULES), secrets.Automaton.states
    monkeypatch.setattr(secrets.Automaton, "states", lambda self, d, o: run(self, d, o, lane))
    rng = random.Random(1)
    for _ in range(30):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        found = scanner.scan(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for i, t in enumerate(texts):
            got = [(x["kind"], x["start"], x["end"]) for x in secrets._code_points(raw[i], found.get(i, []))]
            assert got == plain_spans(t)


def test_secrets_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é token=abcdefghijklmnop end"), (3, "é token=abcdefghijklmnop end"), (None, "x" * 100_000 + " AKIA" + "A" * 20)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(0)).withColumn("kind", F.lit(""))
    got = secrets.find_secrets(docs).collect()
    assert [len(r["spans"]) for r in got] == [0, 0, 1, 1, 1]
    assert tuple(got[2]["spans"][0]) == ("assign", 2, 24)
    red = secrets.redact_secrets(docs).collect()
    assert red[0]["text"] is None and red[2]["text"] == "é [secret] end" and red[2]["kind"] == ""
    assert secrets.find_secrets(docs.where("false")).count() == 0


def test_secrets_extra_rules():
    scanner = secrets.compiled()
    text = b"ghp_" + b"a1B2" * 9 + b" -----BEGIN RSA PRIVATE KEY----- " + b"token=xoxb-123456789012"
    kinds = [k for k, _, _ in scanner.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]]
    assert kinds == ["github", "pem", "assign", "slack"]


def test_private_keys_go_with_their_bodies(spark):
    body = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + "MIIB+a/b9==\n" * 20
    whole = f"-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----"
    cut_off = "-----BEGIN PRIVATE KEY-----\n" + "MIIBabc\n" * 3
    rows = [(1, f"before {whole} after."), (2, f"a {whole}\n{whole} b"), (3, f"x {cut_off} y: it's over."), (4, "-----BEGIN PRIVATE KEY----- is how keys begin")]
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "before [secret] after.", 2: "a [secret]\n[secret] b", 3: "x [secret] y: it's over.", 4: "[secret] is how keys begin"}


def plain_features(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_features(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "a", "a b c d", "a b c d e", "x " * 30, "# é|\x0b*\n# é|\x0b*\n"] + ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.score_quality(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_features(t), t
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["rejected_by"] is not None or not failed
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert kept == {i for i, r in got.items() if r["rejected_by"] is None}
    assert quality.score_quality(docs.where("false")).count() == 0 == quality.filter_quality(docs.where("false")).count()


def test_a_rejected_row_stops_the_cascade(spark):
    docs = spark.createDataFrame([(1, "few words"), (2, "w " * 50)], DOCS)
    boom = F.raise_error(F.lit("evaluated")).cast("long")
    of = {"n_words": F.size(quality.words(F.col("text"))).cast("long"), "later": boom}
    rules = [quality.BASE_RULES[0], quality.Rule("later", lambda f: f["later"] > 0)]
    assert docs.where("doc_id = 1").select(quality.verdict(rules, of).alias("v")).first()[0] == "few_words"
    with pytest.raises(Exception, match="evaluated"):
        docs.where("doc_id = 2").select(quality.verdict(rules, of).alias("v")).collect()


def test_quality_of_long_texts(spark):
    """The sample that orders the rules is bounded in characters; verdicts are of whole texts."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " # " * 200_000), (3, " " * 1_000_000)], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_symbols"], r["rejected_by"]) for r in quality.score_quality(docs).collect()}
    assert got[1] == (400_000, 0, None) and got[2][:2] == (600_000, 200_000) and got[2][2] in ("symbols", "repeated_words") and got[3] == (0, 0, "few_words")


def test_quality_order_changes_no_verdict(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "w " * 50), (3, "clean words that stand in one long enough line here")], DOCS)
    base = quality.score_quality(docs, rules=quality.RULES).collect()
    other = quality.score_quality(docs, rules=tuple(reversed(quality.RULES))).collect()
    assert [r["rejected_by"] is None for r in base] == [r["rejected_by"] is None for r in other] == [False, False, True]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_plan_places_every_piece_once(sizes):
    counts = np.bincount(sizes, minlength=65) if sizes else np.zeros(65, np.int64)
    sequences = packing.plan(counts, 64, rounds=40)
    used = np.zeros(65, np.int64)
    for content, many in sequences:
        assert sum(content) <= 64 and many > 0
        for s in content:
            used[s] += many
    assert (used == counts).all()
    places = packing.Places(sequences)
    taken = set()
    for s in np.flatnonzero(counts).tolist():
        q, o = places.of(np.full(counts[s], s), np.arange(counts[s]))
        for a, b in zip(q.tolist(), o.tolist()):
            assert not any((a, i) in taken for i in range(b, b + s))
            taken |= {(a, i) for i in range(b, b + s)}


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 0.8, 20_000).astype(int), 1, 1023), minlength=1025)
    bins = sum(m for _, m in packing.plan(counts, 1024))
    assert bins <= 1.003 * (counts * np.arange(1025)).sum() / 1024 + 1


def test_packing_rows(spark):
    rng = random.Random(2)
    texts = [None, "", "short", "short", "word " * 3000] + ["".join(rng.choice("ab cé ") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    rows = packing.pack(docs.withColumn("piece", F.lit("clash")), tokenizer_path(), length=256).collect()
    encode = packing.Encoder(tokenizer_path())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*encode(t or ""), 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and 1 <= r["length"] <= 256 and (k == 0 or r["length"] == 256)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in sequences.values():
        at = 0
        for offset, size in sorted(content):
            assert offset == at
            at += size
        assert at <= 256
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / 256 + 2
    assert packing.pack(docs.where("false"), tokenizer_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_equal_the_tokenizer(text):
    encode = _encoder()
    assert list(encode(text)) == encode.exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b", "don't  stop\t\tit's\n\n x", "\x85a\x1c \x1d", "é \u200b x \u3000y", " " * 500, "a" * 2000, "\x00\x01", "½ ² ① Ⅷ"])
def test_fast_ids_of_odd_texts(text):
    encode = _encoder()
    assert list(encode(text)) == encode.exact.encode(text, add_special_tokens=False).ids == encode.fast.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, "a " + " \n\t " * 250_000 + "b"], ids=["spaces", "line ends", "tabs", "mixed"])
def test_long_white_space(text):
    encode = _encoder()
    assert encode.array(text, 2).tolist() == [*encode.exact.encode(text, add_special_tokens=False).ids, 2]


def test_parts_of_a_long_text_give_the_ids_of_the_whole(monkeypatch):
    rng = random.Random(7)
    pieces = ["word", "it's", "wörld", "<|endoftext|>", "  ", "\n\n", "12", "--", "\x85", "\u200b", "é", "\t"]
    encode = _encoder()
    monkeypatch.setattr(packing.Encoder, "PART", 40)
    monkeypatch.setattr(packing.Encoder, "RUN", 9)
    for _ in range(200):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " ", " " * rng.randint(0, 30)]) for _ in range(rng.randint(0, 80)))
        assert encode.array(text, 2).tolist() == [*encode.exact.encode(text, add_special_tokens=False).ids, 2]


def test_packing_of_a_very_long_text(spark):
    text = "some words of a text " * 2_500_000  # 50 MB
    docs = spark.createDataFrame([(decimal.Decimal("1.5"), text), (decimal.Decimal("2.5"), " " * 1_000_000)], "doc_id decimal(4,1), text string")
    sizes = {r["doc_id"]: r["n"] for r in packing.pack(docs, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes[decimal.Decimal("1.5")] == len(_encoder()("some words of a text")) + 2_499_999 * len(_encoder()(" some words of a text")) + 2
    assert sizes[decimal.Decimal("2.5")] == 1_000_001


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n x", "é<|endoftext|>\x85", "<|endoftext|", "<|<|endoftext|>|>", "don't <|endoftext|>don't"])
def test_added_tokens_are_those_of_the_plain_tokenizer(text, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    ids = plain.encode(text, add_special_tokens=False).ids
    assert list(_encoder()(text)) == ids and ids.count(50256) == text.count("<|endoftext|>")
    plain.add_special_tokens([AddedToken("<|end", lstrip=True)])  # one that takes in the space before it
    plain.save(str(tmp_path / "more.json"))
    more = packing.Encoder(str(tmp_path / "more.json"))
    for t in (text, "x  <|end y", text + " <|end"):
        assert list(more(t)) == plain.encode(t, add_special_tokens=False).ids


def _encoder(made=[]):  # noqa: B006
    if not made:
        made.append(packing.Encoder(tokenizer_path()))
    return made[0]


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(1, 40), rng.choice(["big"] * 6 + ["mid", "small"]), rng.choice(["en", "de", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS + ", source string, lang string").withColumn("weight", F.lit("clash"))
    targets = {"source": {"big": 0.5, "mid": 0.25, "small": 0.25}, "lang": {"en": 0.5, "de": 0.3, "(none)": 0.2}}
    plan = mixing.cell_probabilities(docs, targets).toPandas()
    assert plan["weight"].sum() == pytest.approx(1) and plan["probability"].max() == pytest.approx(1)
    for d in ("source", "lang"):
        assert plan.groupby(f"__tm_{d}")["weight"].sum().to_dict() == pytest.approx(targets[d], abs=1e-6)
    expected = (plan["tokens"] * plan["probability"]).groupby(plan["__tm_source"]).sum()
    assert (expected / expected.sum()).to_dict() == pytest.approx(targets["source"], abs=1e-6)
    mixed = mixing.mix_sources(docs, targets=targets).toPandas()
    assert len(mixed) == 3000
    drawn = mixed[mixed["__tm_sampled"]].groupby("__tm_source")["__tm_tokens"].sum()
    assert (drawn / drawn.sum())["big"] == pytest.approx(0.5, abs=0.06)


@pytest.mark.parametrize("stray", ["lone", None])
def test_mixing_is_not_scaled_by_a_stray_source(spark, stray):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(1, 40), "hot" if i % 3 == 0 else f"s{i % 7}", rng.choice(["en", "en", "de"])) for i in range(3000)]
    rows.append((3000, "word " * 20, stray, "en"))
    docs = spark.createDataFrame(rows, DOCS + ", source string, lang string").withColumn("topic", F.lit("t"))
    exact = mixing.cell_probabilities(docs).toPandas()
    assert (exact["tokens"] * exact["probability"]).sum() < 0.1 * exact["tokens"].sum()
    plan = mixing.cell_probabilities(docs, least=0.4).toPandas()
    expected = plan["tokens"] * plan["probability"]
    assert plan["probability"].between(0, 1, inclusive="right").all() and expected.sum() == pytest.approx(0.4 * plan["tokens"].sum())
    lone = plan["__tm_source"] == (stray or "(none)")
    assert plan[lone]["probability"].tolist() == [1.0]
    # the others' shares stay in the proportions of their targets
    by = plan[~lone].assign(expected=expected).groupby("__tm_source")[["weight", "expected"]].sum()
    assert (by["expected"] / by["expected"].sum()).to_dict() == pytest.approx((by["weight"] / by["weight"].sum()).to_dict(), abs=1e-4)
    lang = plan.assign(expected=expected).groupby("__tm_lang")[["weight", "expected"]].sum()
    assert (lang["expected"] / lang["expected"].sum()).to_dict() == pytest.approx(lang["weight"].to_dict(), abs=1e-4)


def test_mixing_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", "s", "en"), (3, "a b", "s", "en"), (3, "a b", "s", "en")], DOCS + ", source string, lang string")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 4 and all(0 < r["__tm_probability"] <= 1 for r in rows)
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_mixing_with_targets_that_cannot_be_met(spark):
    rows = [(i, "word " * 10, "s1" if i % 3 else "s2", "en" if i % 3 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS + ", source string, lang string").withColumn("topic", F.lit("t"))
    left_out = {"source": {"s1": 1.0}, "lang": {"en": 0.5, "de": 0.5}}  # only s2 has de
    with pytest.warns(UserWarning, match="off its target"):
        plan = mixing.cell_probabilities(docs, left_out).toPandas()
    assert plan["gap"].iloc[0] == pytest.approx(0.5) and plan["probability"].between(0, 1).all()
    conflict = {"source": {"s1": 0.9, "s2": 0.1}, "lang": {"en": 0.5, "de": 0.5}}
    with pytest.raises(ValueError, match="not met"):
        mixing.mix_sources(docs, targets=conflict, most_gap=0.01)
    met = mixing.cell_probabilities(docs, {"source": {"s1": 0.5, "s2": 0.5}, "lang": {"en": 0.5, "de": 0.5}}, most_gap=1e-6).toPandas()
    assert met["gap"].iloc[0] < 1e-6


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "en") for i in range(40)], DOCS + ", source string, lang string")
    docs = docs.select("*", F.lit(1).alias("a.b"), F.lit("own").alias("__tm_weight"), F.lit("own").alias("__row"))
    kept = mixing.sampled(docs, least=0.5)
    assert kept.columns == docs.columns and {(r["a.b"], r["__tm_weight"], r["__row"]) for r in kept.collect()} == {(1, "own", "own")}
    twice = mixing.mix_sources(mixing.mix_sources(docs))
    assert twice.count() == 40 and twice.columns.count("__tm_weight") == 1
    long = spark.createDataFrame([(1, "word " * 2_000_000, "s", "en"), (2, "word", "s", "en")], docs.select(*docs.columns[:4]).schema)
    assert {r["__tm_tokens"] for r in mixing.mix_sources(long).collect()} == {2_000_000, 1}


def test_url_intervals(spark):
    entries = spark.createDataFrame(
        [("block", "bad.com", "add", 10), ("block", "bad.com", "remove", 20), ("block", "bad.com", "add", 30), ("allow", "ok.bad.com", "add", 12), ("block", "same.com", "add", 5), ("block", "same.com", "remove", 5)],
        "list string, domain string, action string, at int",
    )
    urls_ = ["http://bad.com/x", "https://u@Sub.BAD.com:80/y?z", "http://ok.bad.com", "http://notbad.com", "http://same.com", "nonsense", None]
    rows = [(i * 100 + t, u, t) for i, u in enumerate(urls_) for t in (9, 10, 15, 20, 35)] + [(999, urls_[0], None)]
    got = {r["page_id"]: (r["verdict"], r["kept"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched int"), entries).collect()}
    on = {10, 15, 35}
    for t in (9, 10, 15, 20, 35):
        assert got[t] == (("block", False) if t in on else (None, True))
        assert got[100 + t] == got[t]
        assert got[200 + t] == (("allow", True) if t >= 12 else got[t])
        assert all(got[100 * i + t] == (None, True) for i in (3, 4, 5, 6))
    assert got[999] == (None, True)


def test_url_filter_edge_rows(spark):
    entries = spark.createDataFrame(
        [("block", "a.com", "add", 1), ("block", "a.com", "add", 1), ("allow", "x.a.com", "add", 1), ("block", "x.a.com", "add", 1), ("block", "[::1]", "add", 1), ("block", "B.org", "add", 5), ("block", "b.org", "remove", 5), ("block", "1]", "add", 1)],
        "list string, domain string, action string, at int",
    )
    found = [("http://a.com./", ("a.com", "block", False)), ("http://y.a.com..:80/", ("a.com", "block", False)), ("http://x.a.com/", ("x.a.com", "block", False)), ("http://[::1]:8080/", ("[::1]", "block", False)), ("http://[::2]/", (None, None, True)),
             ("http://b.org", (None, None, True)), ("http://./", (None, None, True)), ("", (None, None, True)), (None, (None, None, True)), ("http://" + "s." * 300 + "a.com/" + "p" * 100_000, ("a.com", "block", False))]
    rows = [(i if i % 4 else None, u, 9, "k") for i, (u, _) in enumerate(found)] * 2
    captures = spark.createDataFrame(rows, "host int, url string, kept int, domain string")
    got = urls.filter_urls(captures, entries, id_col="host", time_col="kept")
    assert got.columns == ["id", "host", "time", "domain", "verdict", "kept"]
    want = [(i if i % 4 else None, *w) for i, (_, w) in enumerate(found)] * 2
    assert sorted(map(str, [(r["id"], r["domain"], r["verdict"], r["kept"]) for r in got.collect()])) == sorted(map(str, want))
    assert urls.filter_urls(captures.where("false"), entries, id_col="host", time_col="kept").count() == 0
    assert urls.filter_urls(captures, entries.where("false"), id_col="host", time_col="kept").where("kept").count() == len(rows)


def test_quality_with_an_id_named_like_a_feature(spark):
    docs = spark.createDataFrame([(7, "one two two"), (8, None)], "n_words long, text string")
    got = quality.score_quality(docs, id_col="n_words")
    assert got.columns[:2] == ["n_words", "n_words_"]
    assert {r["n_words"]: r["n_words_"] for r in got.collect()} == {7: 3, 8: 0}
