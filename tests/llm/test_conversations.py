"""Conversation repair against a plain search for the cheapest, ASCII-least edits."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from trailmark.llm import conversations as C

TURNS = "conv_id long, turn long, role string, text string"
SPACE = r"[\x20\x09-\x0D]"


def plain(rows):
    """What the report says of one conversation's rows, which are in order."""
    initials = [r[:1] for _, r, _ in rows]
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(f"{SPACE}+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        options = []
        if inserted < 4:
            options += [("I", (state, w[0]), w, "", 2, i) for w in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            more = int(faults[i] == "truncated")
            options.append(("D", None, None, None, 3, i + 1))
            if faults[i] not in ("blank", "duplicate"):
                options.append(("K", (state, initials[i]), role, text, more, i + 1))
                options += [("R", (state, w[0]), w, text, 2 + more, i + 1) for w in ("user", "assistant")]
        for letter, move, role, text, cost, j in options:
            to = state if move is None else step.get(move)
            if to is None:
                continue
            rest = best(j, to, inserted + 1 if letter == "I" else 0)
            if rest:
                out.append((cost + rest[0], letter + rest[1], (() if move is None else (f"{role}:{text}",)) + rest[2]))
        return min(out, default=None)

    sys.setrecursionlimit(20_000)
    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def expected(rows):
    """By conversation, of rows that have no ties but equal ones."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: plain(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for c, r in convs.items()}


def reported(spark, rows, ids=None):
    turns = spark.createDataFrame(rows, TURNS)
    return {r[0]: tuple(r)[1:] for r in C.report(turns, ids if ids is not None else turns).collect()}


def random_rows(rng, conv, n):
    texts = ["Yes.", "No", "Why?", "", " \t", "Well!", "so ", "End. \n"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", "u"]
    return [(conv, t if rng.random() < 0.95 or t else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.choice(texts)}{t}.") for t in range(n)]


def test_any_codes_match_a_plain_search():
    """Every sequence of up to four rows of the nine kinds."""
    text = {"d": ("user", ""), **{c: ({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[c], ".") for c in "suax"}}
    for n in range(4):
        for codes in itertools.product("suaxdUX", repeat=n):
            rows = []
            for i, c in enumerate(codes):
                role, end = text[c.lower()] if c != "d" else text["d"]
                rows.append((i, role, "" if c == "d" else f"{i}" + ("" if c.isupper() else end)))
            letters = C.whole("".join(codes))
            assert (C.path("".join(codes), letters, C.START)[1], letters) == plain(rows)[5:7], codes


@pytest.mark.parametrize("segment", [3, 2048])
def test_report_matches_a_plain_search(spark, segment, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = [x for conv in range(60) for x in random_rows(rng, conv, rng.randint(1, 14))] + random_rows(rng, 99, 60)
    assert reported(spark, rows) == expected(rows)


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 16)
    rng = random.Random(3)
    rows = random_rows(rng, 7, 300) + random_rows(rng, 8, 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert reported(spark, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (2, 0, "user", None), (None, 0, "user", "Hm."), (None, 1, "assistant", "Oh."), (4, 3, "user", "x" * 300_000), (4, 3, "user", "x" * 300_000), (4, 9, "ünder", "!")]
    ids = spark.createDataFrame([(c, "", 0) for c in (1, 2, None, 4, 5, 5)], "conv_id long, text string, part int")
    assert reported(spark, rows, ids) == expected(rows) | {5: NONE}
    empty = spark.createDataFrame([], TURNS)
    assert C.report(empty, empty).count() == 0 and C.repair(empty).count() == 0
    assert set(reported(spark, [], ids).values()) == {NONE}


def test_repaired_rows_follow_the_pattern(spark):
    rng = random.Random(11)
    rows = [x for conv in range(40) for x in random_rows(rng, conv, rng.randint(1, 12))]
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], TURNS + ", seq int, key string").withColumnRenamed("conv_id", "id")
    out = {}
    for r in C.repair(turns, id_col="id").orderBy("part", "seq", "edit_no").collect():
        if r["role"] is not None:
            out.setdefault(r["id"], []).append((r["role"], r["text"]))
    want = expected(rows)
    for conv in range(40):
        lines = out.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest() == want[conv][-1]


def test_damage_follows_the_hash(spark):
    rows = [(c, t, None if (c + (t or 0)) % 9 == 0 else "assistant", None if c * (t or 0) % 11 == 5 else "A. B! C?") for c in range(30) for t in [*range(5), None]]
    turns = spark.createDataFrame(rows, TURNS).withColumn("fate", F.lit("x"))
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text or " ") if fate == 2 else " " if text is None else text
        want += [(c, t, "user" if fate == 4 else role or " ", text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in C.damage(turns).collect())
