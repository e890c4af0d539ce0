"""Personal data against plain regexes."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import personal

DOCS = "doc_id long, text string"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def checks(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_ok(kind, x):
    digits = re.sub(r"[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and checks(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text) if plain_ok(k, m[0])]


def base_spans(text):
    raw = text.encode()
    return [s for s in personal.code_points(raw, personal.scan(raw)) if s[0] in PLAIN]


PIECES = [
    "a", "Z.", "joe", "@", "@x.org", "ex-a", ".", "..", "com", " ", "-", "--", "+", "+1", "(", ")", "0", "7", "12", "255", "256", "1.2.3.4", "192.168.0.1", "4111111111111111", "4111 1111 1111 1111",
    "5500-0000-0000-0004", "6", "0000", "é", "ß@", "\n", "%", "_", "+49 30 1234567", "12345678", "00.1",
]


def test_spans_match_plain_regexes(monkeypatch):
    rng = random.Random(5)
    for piece in (40, 1 << 20):  # anchors in pieces, too
        monkeypatch.setattr(personal, "PIECE", piece)
        for _ in range(3000):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
            assert base_spans(text) == plain_spans(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123 -.+()@ab%é", max_size=80))
def test_spans_of_any_text(text):
    assert base_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=15, max_size=18), st.lists(st.sampled_from(["", " ", "-"]), min_size=18, max_size=18))
def test_valid_cards_of_any_spacing_are_found(digits, between):
    last = next(d for d in range(10) if checks("".join(map(str, digits)) + str(d)))
    card = "".join(str(d) + s for d, s in zip(digits, between)) + str(last)
    text = f"é paid with {card}, thanks"
    assert base_spans(text) == plain_spans(text) and any(k == "card" for k, _, _ in base_spans(text))


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 is mine", "iban", "DE89 3704 0044 0532 0130 00"),
        ("my iban GB29NWBK60161331926819.", "iban", "GB29NWBK60161331926819"),
        ("IBAN: DE89 3704 0044 0532 0130 01 is wrong", "iban", None),
        ("SSN 123-45-6789", "ssn", "123-45-6789"),
        ("Social Security number: 666-45-6789", "ssn", None),
        ("Account no. 00123456 was closed", "account", "00123456"),
        ("passport number X1234567", "account", "X1234567"),
        ("accountability 12345678", "account", None),
        ("on account of 3 things", "account", None),
        ("see https://joe:hunter2@example.org/x", "login", "joe:hunter2"),
        ("see https://example.org:8080/@x", "login", None),
    ],
)
def test_cues(text, kind, found):
    got = [text.encode()[s:e].decode() for k, s, e in personal.scan(text.encode()) if k == kind]
    assert got == ([found] if found else [])


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é joe@x.org +49 30 1234567"), (3, "é joe@x.org +49 30 1234567"), (None, "x" * 3_000_000 + " joe@x.org"), (4, "10.0.0.1")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(0)).withColumn("kind", F.lit("")).withColumn("a.b", F.lit(1))
    got = [[tuple(s) for s in r["spans"]] for r in personal.find_personal(docs).collect()]
    two = [("email", 2, 11), ("phone", 12, 26)]
    assert got == [[], [], two, two, [("email", 3_000_001, 3_000_010)], [("ip", 0, 8)]]
    red = personal.redact_personal(docs).collect()
    assert red[0]["text"] is None and red[2]["text"] == "é [email] [phone]" and red[5]["text"] == "[ip]" and red[5]["a.b"] == 1
    assert personal.find_personal(docs.where("false")).count() == 0
    named = personal.find_personal(docs.withColumnRenamed("doc_id", "start"), id_col="start")
    assert named.columns == ["start", "spans"] and named.count() == 6


@pytest.mark.parametrize("text", ["1." * 400_000, "1 " * 400_000, "a@" * 400_000, "+1" * 400_000, "+1(" * 300_000, "x" * 800_000 + "@", "://a:" * 200_000, "iban " * 100_000, "12345678" * 100_000])
def test_repeating_texts_take_linear_time(text):
    start = time.perf_counter()
    personal.scan(text.encode())
    assert time.perf_counter() - start < 20


def test_query_against_plain_regexes(spark):
    import hashlib

    from trailmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_personal_data"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= {x for x in r["spans"].split(",") if x}
