"""Conversation structure repair on a bidirectional tight-arc DAG.

A conversation's repaired role initials must read ``(s?(ua)+)?``.  Its edits are
paths through a graph of nodes (rows read, state of that pattern): keeping or
reroling a row and inserting one move the state, deleting doesn't.  Forward and
backward minimum costs of all nodes tell the arcs of cheapest paths, those where
forward cost, arc and backward cost add up to the total; from the start, the set
of nodes reached so far follows the tight arcs of the least letter among those
that leave it, which gives the ASCII-least of the cheapest edits.

Rows are range-partitioned by conversation and place and cut into segments of at
most a few thousand rows, so a conversation of any length is spread over tasks.
A conversation inside one segment is settled there.  Of the others, each segment
is a 4 x 4 matrix of least costs between states; folds over these matrices (one
narrow row a segment) give the costs at its two ends, and the state that the
chosen path enters it with; then the segments are settled apart from each other.

Defined results: a null role or text is one space (a role outside the pattern, a
blank text); rows of a conversation go by turn, nulls first, then by role and
text's digest, so ties are in one order and equal rows are interchangeable; rows
with a null id form one conversation; repeated rows are duplicates; other columns
of any name may stand beside the four.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, trimmed

#: Rows a segment, and bytes that are held until a conversation ends.
SEGMENT, HELD = 2048, 16 << 20
#: States: nothing written, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: Where an initial leads from each state; -1: nowhere.
MOVES = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: The only row that may be written next after each state.
NEXT = (USER, USER, ASSISTANT, USER)
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_SPACE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text) with faults by a hash of id and turn, to try the repair on: of
    twenty values 0 drops a row, 1 empties its text, 2 removes its full stops, 3 repeats
    it, 4 makes it the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    read = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), fate.alias("fate")).where("fate <> 0")
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return read.select("id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy").toDF(id_col, turn_col, role_col, text_col)


# -------------------------------------------------------------------- segments

_ROW = "turn long, role string, text string, digest binary"


def _key(column: str):
    """A text that tells ids apart, null among them."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def segments(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, id, part, seq, open, rows) in the shared folder: runs of a conversation's rows in
    order.  ``part`` and ``seq`` order segments; open: others of its conversation may exist."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = rows.select(_key(id_col).alias("key"), F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    order = ["key", "turn", "role", "digest", "copy"]
    placed = read.withColumn("digest", digest).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    schema = T.StructType([
        T.StructField("key", T.StringType()), read.schema["id"], T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("open", T.BooleanType()),
        T.StructField("rows", T.ArrayType(T.StructType.fromDDL(_ROW))),
    ])
    names = schema["rows"].dataType.elementType.names

    def cut(batches):
        part, seq, held, begun = TaskContext.get().partitionId(), 0, None, True
        spans: list[tuple[int, int, bool]] = []

        def add(start: int, end: int, open_: bool) -> None:
            for at in range(start, end, SEGMENT):
                spans.append((at, min(end, at + SEGMENT), open_ or end - start > SEGMENT))

        def emit(table: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal seq
            starts = pa.array([s for s, _, _ in spans])
            lists = pa.ListArray.from_arrays(pa.array([*[s for s, _, _ in spans], spans[-1][1]], pa.int32()), pa.StructArray.from_arrays([table.column(c) for c in names], names=names))
            numbers = [pa.array(np.full(len(spans), part, np.int32)), pa.array(np.arange(seq, seq + len(spans))), pa.array([o for _, _, o in spans])]
            seq += len(spans)
            spans.clear()
            return pa.RecordBatch.from_arrays([table.column("key").take(starts), table.column("id").take(starts), *numbers, lists], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = table.column("key")
            starts = [0, *(np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()]
            for start, end in zip(starts, starts[1:]):
                add(start, end, begun)  # the first one may have begun in another segment
                begun = False
            held = table.slice(starts[-1])
            if held.num_rows >= SEGMENT or held.nbytes >= HELD:
                add(starts[-1], len(keys), True)
                held, begun = None, True
            if spans:
                yield emit(table)
        if held is not None:
            add(0, held.num_rows, True)  # and the last one may go on in another
            yield emit(held)

    return materialize(placed.mapInArrow(trimmed(cut), schema), "segments")


# ------------------------------------------------------------- the graph's costs


def faults(roles: list[str], texts: list[str], digests: list[bytes], earlier: list[bytes] | None = None) -> tuple[str, int, int, int]:
    """A letter for every row, and how many are blank, duplicate and truncated: its initial
    (x: outside the pattern), in upper case if it is truncated; d if it must go."""
    out, seen, counts = [], set(earlier or ()), [0, 0, 0]
    for role, text, digest in zip(roles, texts, digests):
        body = text.rstrip(_SPACE)
        initial = role[:1] if role[:1] in MOVES else "x"
        if not body or digest in seen:
            counts[1 if body else 0] += 1
            initial = "d"
        elif body[-1] not in ".!?":
            counts[2] += 1
            initial = initial.upper()
        seen.add(digest)
        out.append(initial)
    return "".join(out), *counts


def arcs(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the arcs that read a row."""
    out = [("D", state, DELETE)]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        kept = MOVES.get(code.lower(), (-1,) * 4)[state]
        if kept >= 0:
            out.append(("K", kept, more))
        out.append(("R", NEXT[state], REROLE + more))
    return out


ARCS = {code: [arcs(code, q) for q in range(4)] for code in "suaxSUAXd"}


def opened(costs: list[int]) -> list[int]:
    """Forward costs after any insertions; they lead from a state to the next."""
    out = list(costs)
    for q in range(4):
        out[NEXT[q]] = min(out[NEXT[q]], out[q] + INSERT)
    return out


def closed(costs: list[int]) -> list[int]:
    """Backward costs before any insertions."""
    out = list(costs)
    for q in (USER, ASSISTANT, START, SYSTEM):
        out[q] = min(out[q], out[NEXT[q]] + INSERT)
    return out


#: Backward costs behind the last row: nothing written, or an assistant's row last.
ACCEPT = closed([0, FAR, FAR, 0])
ENTRY = [0, FAR, FAR, FAR]


def forward(codes: str, entry: list[int]) -> list[list[int]]:
    """Least costs from the start of all nodes, given those of the first ones."""
    out = [opened(entry)]
    for code in codes:
        now = [FAR] * 4
        for q, cost in enumerate(out[-1]):
            for _, to, more in ARCS[code][q]:
                now[to] = min(now[to], cost + more)
        out.append(opened(now))
    return out


def backward(codes: str, leave: list[int]) -> list[list[int]]:
    """Least costs to the end of all nodes, given those of the last ones."""
    out = [closed(leave)]
    for code in reversed(codes):
        out.append(closed([min(more + out[-1][to] for _, to, more in ARCS[code][q]) for q in range(4)]))
    return out[::-1]


def traverse(codes: str, entry: list[int], leave: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least letters along tight arcs from a state that a cheapest path enters, and the
    state it ends in.  Insertions behind the last row belong to the next segment."""
    f, b = forward(codes, entry), backward(codes, leave)
    total = min(x + y for x, y in zip(f[0], b[0]))
    letters, frontier, i = [], {state}, 0
    while i < len(codes) or last:
        tight: dict[str, set[int]] = {}
        for q in frontier:
            if f[i][q] + INSERT + b[i][NEXT[q]] == total:
                tight.setdefault("I", set()).add(NEXT[q])
            for letter, to, more in ARCS[codes[i]][q] if i < len(codes) else ():
                if f[i][q] + more + b[i + 1][to] == total:
                    tight.setdefault(letter, set()).add(to)
        if not tight:
            break
        letter = min(tight)
        letters.append(letter)
        frontier = tight[letter]
        i += letter != "I"
    return "".join(letters), min(frontier)  # letters determine the state: the set holds one


@lru_cache(maxsize=1 << 16)
def whole(codes: str) -> str:
    """The edits of a conversation in one segment."""
    return traverse(codes, ENTRY, ACCEPT, START, True)[0]


def path(codes: str, letters: str, state: int) -> tuple[list[tuple[int, str | None]], int]:
    """(row or -1, new role or None for its own) of every edit, and what the edits cost."""
    out, cost, i = [], 0, 0
    for letter in letters:
        if letter == "I":
            state, cost = NEXT[state], cost + INSERT
            out.append((-1, WRITTEN[state]))
            continue
        _, state, more = next(a for a in ARCS[codes[i]][state] if a[0] == letter)
        out.append((i, WRITTEN[state] if letter == "R" else None))
        cost, i = cost + more, i + 1
    return out, cost


# ------------------------------------------------------------ across segments

_COSTS = "array<long>"
_SETTLED = (
    "key string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<edit:string,role:string,text:string>>"
)
LEGAL = {"su", "ua", "au"}


def _rows_of(batch: pa.RecordBatch):
    """(place in the batch, turns, roles, texts, digests) of every segment."""
    lists = batch.column(batch.schema.get_field_index("rows"))
    ends = np.cumsum([0, *pc.list_value_length(lists).to_pylist()]).tolist()
    fields = [c.to_pylist() for c in lists.flatten().flatten()]
    for i in range(len(ends) - 1):
        yield i, *[f[ends[i] : ends[i + 1]] for f in fields]


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _coded(batches):
    """Open segments as letters, with least costs between states and what borders need."""
    for batch in batches:
        key, part, seq, earlier = _columns(batch, "key", "part", "seq", "earlier")
        out = []
        for i, turns, roles, texts, digests in _rows_of(batch):
            codes, *counts = faults(roles, texts, digests, earlier[i])
            costs = [x for q in range(4) for x in forward(codes, [0 if p == q else FAR for p in range(4)])[-1]]
            out.append({"key": key[i], "part": part[i], "seq": seq[i], "codes": codes, "counts": counts, "costs": costs, "turn": turns[-1], "initial": roles[-1][:1]})
        yield pa.RecordBatch.from_pylist(out, _CODED_ARROW)


_CODED = f"key string, part int, seq long, codes string, counts {_COSTS}, costs {_COSTS}, turn long, initial string"
_LONGS = pa.list_(pa.int64())
_PLACE = [("key", pa.string()), ("part", pa.int32()), ("seq", pa.int64())]
_CODED_ARROW = pa.schema([*_PLACE, ("codes", pa.string()), ("counts", _LONGS), ("costs", _LONGS), ("turn", pa.int64()), ("initial", pa.string())])
_UP = f"key string, part int, seq long, costs {_COSTS}, entry {_COSTS}, before_turn long, before_initial string"
_UP_ARROW = pa.schema([*_PLACE, ("costs", _LONGS), ("entry", _LONGS), ("before_turn", pa.int64()), ("before_initial", pa.string())])
_DOWN = f"key string, part int, seq long, entry {_COSTS}, leave {_COSTS}, last boolean, before_turn long, before_initial string"
_DOWN_ARROW = pa.schema([*_PLACE, ("entry", _LONGS), ("leave", _LONGS), ("last", pa.bool_()), ("before_turn", pa.int64()), ("before_initial", pa.string())])
_WALKED = "key string, part int, seq long, state int"
_WALKED_ARROW = pa.schema([*_PLACE, ("state", pa.int32())])


def _upward(batches):
    """Segments of a conversation in order: the costs that each is entered with."""
    held = None
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if held is None or held[0] != x["key"]:
                held = x["key"], ENTRY, None, None
            _, entry, turn, initial = held
            out.append({**{c: x[c] for c in ("key", "part", "seq", "costs")}, "entry": entry, "before_turn": turn, "before_initial": initial})
            held = x["key"], [min(min(entry[q] + x["costs"][4 * q + t] for q in range(4)), FAR) for t in range(4)], x["turn"], x["initial"]
        yield pa.RecordBatch.from_pylist(out, _UP_ARROW)


def _downward(batches):
    """Segments of a conversation from its end: the costs that are left behind each."""
    held = None
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            last = held is None or held[0] != x["key"]
            leave = ACCEPT if last else held[1]
            out.append({**{c: x[c] for c in ("key", "part", "seq", "entry", "before_turn", "before_initial")}, "leave": leave, "last": last})
            held = x["key"], [min(min(x["costs"][4 * q + t] + leave[t] for t in range(4)), FAR) for q in range(4)]
        yield pa.RecordBatch.from_pylist(out, _DOWN_ARROW)


def _exits(batches):
    """The state in which the chosen path leaves a segment, for each that it may enter with."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            f, b = opened(x["entry"]), backward(x["codes"], x["leave"])[0]
            total = min(p + q for p, q in zip(f, b))
            ends = [traverse(x["codes"], x["entry"], x["leave"], q, x["last"])[1] if f[q] + b[q] == total else -1 for q in range(4)]
            out.append({"key": x["key"], "part": x["part"], "seq": x["seq"], "costs": ends})
        yield pa.RecordBatch.from_pylist(out, pa.schema([*_PLACE, ("costs", _LONGS)]))


def _walk(batches):
    """Segments of a conversation in order: the state that the chosen path enters each with."""
    held = None
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            state = START if held is None or held[0] != x["key"] else held[1]
            out.append({"key": x["key"], "part": x["part"], "seq": x["seq"], "state": state})
            held = x["key"], x["costs"][state]
        yield pa.RecordBatch.from_pylist(out, _WALKED_ARROW)


def _settled(batches):
    """Segments with their edits.  One without ``codes`` is a conversation of its own."""
    kind = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
                      ("edits", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))), ("part", pa.int32()), ("seq", pa.int64())])
    for batch in batches:
        key, part, seq, codes_, counts_, entry, leave, last, state_, turn, initial = _columns(batch, "key", "part", "seq", "codes", "counts", "entry", "leave", "last", "state", "before_turn", "before_initial")
        out = []
        for i, turns, roles, texts, digests in _rows_of(batch):
            if codes_[i] is None:
                codes, *counts = faults(roles, texts, digests)
                letters, state = whole(codes), START
            else:
                codes, counts, state = codes_[i], counts_[i], state_[i]
                letters, _ = traverse(codes, entry[i], leave[i], state, last[i])
            steps, cost = path(codes, letters, state)
            initials = [*([initial[i]] if initial[i] is not None else []), *(r[:1] for r in roles)]
            known = [t for t in turns if t is not None]
            edits = [(e, None, None) if e == "D" else (e, role or roles[r], "" if r < 0 else texts[r]) for e, (r, role) in zip(letters, steps)]
            out.append({
                "key": key[i], "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len({*known} - {turn[i]}),
                "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "cost": cost,
                "audit": letters, "edits": [{"edit": e, "role": r, "text": t} for e, r, t in edits], "part": part[i], "seq": seq[i],
            })
        yield pa.RecordBatch.from_pylist(out, kind)


def _frames(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled segments: of conversations in one segment, and of the others."""
    settled = f"{_SETTLED}, part int, seq long"
    alone = cut.where("not open").select("key", "part", "seq", "rows", *[F.lit(None).cast(k).alias(c) for c, k in (("codes", "string"), ("counts", _COSTS), ("entry", _COSTS), ("leave", _COSTS), ("last", "boolean"), ("state", "int"), ("before_turn", "long"), ("before_initial", "string"))])
    several = cut.where("open")
    place = F.struct("part", "seq")
    digests = several.select("key", "part", "seq", F.explode(F.array_distinct("rows.digest")).alias("digest"))
    first = F.min(place).over(Window.partitionBy("key", "digest"))
    earlier = digests.withColumn("first", first).where(F.col("first") < place).groupBy("part", "seq").agg(F.collect_list("digest").alias("earlier"))  # a segment's rows at most
    coded = materialize(several.join(earlier, ["part", "seq"], "left").select("key", "part", "seq", "rows", "earlier").mapInArrow(trimmed(_coded), _CODED), "codes")
    in_order = lambda df: df.repartition("key").sortWithinPartitions("key", "part", "seq")
    up = materialize(in_order(coded.drop("codes", "counts")).mapInArrow(_upward, _UP), "upward")
    down = materialize(up.repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seq")).mapInArrow(_downward, _DOWN), "downward")
    known = coded.select("part", "seq", "codes", "counts").join(down, ["part", "seq"])
    exits = materialize(known.mapInArrow(_exits, f"key string, part int, seq long, costs {_COSTS}"), "exits")
    states = in_order(exits).mapInArrow(_walk, _WALKED).drop("key")
    entered = materialize(known.drop("key").join(states, ["part", "seq"]), "entered")
    return alone.mapInArrow(trimmed(_settled), settled), several.select("key", "part", "seq", "rows").join(entered, ["part", "seq"]).mapInArrow(trimmed(_settled), settled)


def _hashed(batches):
    """(key, sha256) of repaired conversations, read line by line in order."""
    held, digest, lines = None, None, 0
    for batch in batches:
        out = []
        for key, edits in zip(*_columns(batch, "key", "edits")):
            if key != held:
                if held is not None:
                    out.append({"key": held, "sha": digest.hexdigest()})
                held, digest, lines = key, hashlib.sha256(), 0
            for e in edits:
                if e["role"] is not None:
                    digest.update(("\n" if lines else "").encode() + f"{e['role']}:{e['text']}".encode())
                    lines += 1
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("sha", pa.string())]))
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"key": held, "sha": digest.hexdigest()}], pa.schema([("key", pa.string()), ("sha", pa.string())]))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, part, seq, edit_no, edit, role, text): every edit of every conversation, by part,
    seq and edit_no in order; role and text as repaired, null where a row is deleted."""
    cut = segments(rows, id_col, turn_col, role_col, text_col)
    alone, several = _frames(cut)
    edits = alone.unionByName(several).select("part", "seq", F.posexplode("edits").alias("edit_no", "e")).select("part", "seq", "edit_no", "e.*")
    return cut.select("part", "seq", "id").join(edits, ["part", "seq"]).select(F.col("id").alias(id_col), "part", "seq", "edit_no", "edit", "role", "text")


def report(rows: DataFrame, ids: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for
    every id of ``ids``, whether it has rows or not.  A conversation's hash is of one
    stream by its definition: where it spans segments, its lines pass one task in order,
    held one batch at a time."""
    alone, several = _frames(segments(rows, id_col, turn_col, role_col, text_col))
    lines = F.transform(F.filter("edits", lambda e: e["role"].isNotNull()), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    one = alone.select("key", "first_turn", "last_turn", "turns", *counts, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))
    several = materialize(several, "settled")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "")
    summed = several.groupBy("key").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.sum("turns").alias("turns"), *[F.sum(c).alias(c) for c in counts], audit.alias("audit"))
    streams = several.select("key", "part", "seq", "edits").repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(trimmed(_hashed), "key string, sha string")
    found = one.unionByName(summed.join(streams, "key"))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    every = ids.select(F.col(id_col).alias("id"), _key(id_col).alias("key")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    joined = every.join(found, "key", "left").withColumn("gaps", gaps)
    return joined.select(F.col("id").alias(id_col), zero("gaps"), *[zero(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", none).alias("repaired_sha256"))
