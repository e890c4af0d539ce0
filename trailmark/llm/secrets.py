"""Secret scans by one combined deterministic automaton.

All rules are compiled together: their syntax trees become one position-free
NFA over bytes, subset construction makes it deterministic, partition
refinement minimises it, and the result is a transition array over byte
classes.  One pass over the bytes then tells, for every byte, which rules have
a match ending there.  A reversed automaton per rule walks back from such an
end to the leftmost start.

Texts are cut into lanes that advance together, one byte of each lane a step;
a lane that began in the wrong state is run again until its states agree with
the ones already found, so the result is that of one sequential pass, and a
very long text is no slower by the byte than a short one.

Defined results: a null or empty text has no spans; spans of a rule are
leftmost and non-overlapping; positions are code points, end exclusive; rows
are independent, so repeated rows get repeated results.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, text_buffer, trimmed


@dataclass(frozen=True)
class Rule:
    """``pattern`` must end in what repeats, or in fixed text, at whose first
    occurrence a match then ends; its last group, if it has one, or else the whole
    match must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Public token formats, beyond the base.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 16),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 34),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]*"),  # also a key that is cut off
    Rule("pem_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=:,\x09\x0A\x0D\x20-]*-----END [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


# ------------------------------------------------------------------ compilation


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, at: int, fold: bool, back: bool) -> int:
        """Adds a syntax tree from state ``at``; its end state.  back: reversed."""
        for op, arg in reversed(list(tree)) if back else tree:
            if op is rc.SUBPATTERN:
                _, on, off, body = arg
                at = self.add(body, at, (fold or bool(on & re.I)) and not off & re.I, back)
            elif op is rc.BRANCH:
                end = self.state()
                for body in arg[1]:
                    start = self.state()
                    self.free[at].append(start)
                    self.free[self.add(body, start, fold, back)].append(end)
                at = end
            elif op is rc.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self.add(body, at, fold, back)
                if most is rc.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.free[at] += [loop, end]
                    self.free[self.add(body, loop, fold, back)] += [loop, end]
                    at = end
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.free[at].append(end)
                        at = self.add(body, at, fold, back)
                    self.free[at].append(end)
                    at = end
            else:
                end = self.state()
                self.moves[at].append((_bytes_of(op, arg, fold), end))
                at = end
        return at


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is rc.LITERAL:
        found = {arg}
    elif op is rc.IN:
        found = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                found.add(x)
            elif kind is rc.RANGE:
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {kind}")
    else:
        raise ValueError(f"not supported in a rule: {op}")
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {ord(c) for b in found if chr(b).isalpha() for c in (chr(b).lower(), chr(b).upper())}
    return frozenset(found)


class Automaton:
    """A minimal DFA: ``table[state * width + byte_class]`` and a bit per rule in
    ``accepts[state]``; state 0 is the start."""

    def __init__(self, patterns: list[str], anywhere: bool, back: bool = False) -> None:
        nfa = _Nfa()
        root, ends = nfa.state(), {}
        for i, pattern in enumerate(patterns):
            start = nfa.state()
            nfa.free[root].append(start)
            ends[nfa.add(rp.parse(pattern), start, False, back)] = 1 << i
        sets = {b for moves in nfa.moves for b, _ in moves}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.classes = np.array([kinds[s] for s in signature], np.uint8)
        member = [int(np.flatnonzero(self.classes == c)[0]) for c in range(len(kinds))]

        def closed(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(x for x in seen if nfa.moves[x] or x in ends)

        first = closed([root])
        number, todo, table = {first: 0}, [first], []
        while todo:
            now = todo.pop(0)
            row = []
            for b in member:
                to = closed({t for s in now for bytes_, t in nfa.moves[s] if b in bytes_} | (set(first) if anywhere else set()))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in number], np.int64)
        table = np.array(table, np.int64)
        block = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:  # states are split until their moves agree
            finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        block = np.unique(block, return_index=True)[1].argsort().argsort()[block]  # the start's block is number 0
        keep = np.unique(block, return_index=True)[1]
        self.width = len(member)
        self.table = block[table[keep]].astype(np.uint16).ravel()
        self.accepts = accepts[keep].astype(np.min_scalar_type(int(accepts.max())))
        none = self.accepts == 0
        rows = self.table.reshape(-1, self.width)
        self.dead = {int(s) for s in np.flatnonzero(none & (rows == np.arange(len(rows))[:, None]).all(axis=1))}

    def states(self, data: np.ndarray, offsets: np.ndarray, lane: int = 2048) -> np.ndarray:
        """The state after every byte of every row."""
        classes = self.classes[data]
        out = np.zeros(len(data), np.uint16)
        lengths = np.diff(offsets)
        lanes = -(-lengths // lane)
        row = np.repeat(np.arange(len(lengths)), lanes)
        if not len(row):
            return out
        place = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[:-1][row] + place * lane
        length = np.minimum(lane, offsets[1:][row] - start)
        entry = np.zeros(len(row), np.uint16)
        self._run(classes, out, start, length, entry, False)
        goes_on = np.flatnonzero(place > 0)
        while len(goes_on):
            true = out[start[goes_on] - 1]
            wrong = true != entry[goes_on]
            lanes_ = goes_on[wrong]
            if not len(lanes_):
                break
            entry[lanes_] = true[wrong]
            self._run(classes, out, start[lanes_], length[lanes_], entry[lanes_], True)
        return out

    def _run(self, classes, out, start, length, entry, until_same: bool) -> None:
        order = np.argsort(-length, kind="stable")
        at, state, left = start[order].copy(), entry[order].astype(np.int64), length[order]
        for j in range(int(left[0])):
            n = int(np.searchsorted(-left, -j, "left"))  # lanes with more than j bytes
            if n < len(at):
                at, state, left = at[:n], state[:n], left[:n]
            state = self.table.take(state * self.width + classes.take(at)).astype(np.int64)
            if until_same:
                go = out.take(at) != state
                if not go.all():
                    at, state, left = at[go], state[go], left[go]
                if not len(at):
                    return
            out[at] = state
            at += 1

    def farthest(self, text: bytes, at: int, step: int, stop: int) -> int:
        """Runs from ``at`` by ``step`` up to ``stop``: the last place at which it
        accepted, or -1."""
        table, classes, accepts, dead, width, state, found = self._lists()
        i = at
        while i != stop:
            state = table[state * width + classes[text[i]]]
            if accepts[state]:
                found = i
            elif state in dead:
                break
            i += step
        return found

    def _lists(self):
        if not hasattr(self, "_plain"):
            self._plain = (self.table.tolist(), self.classes.tolist(), self.accepts.tolist())
        table, classes, accepts = self._plain
        return table, classes, accepts, self.dead, self.width, 0, -1


class Scanner:
    """The combined automaton of all rules, and a reversed one for each."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], anywhere=True)
        self.one = [Automaton([r.pattern], anywhere=True) for r in rules]
        self.back = [Automaton([r.pattern], anywhere=False, back=True) for r in rules]
        self.exact = [re.compile(r.pattern.encode()) for r in rules]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """Spans in bytes by row, ordered by start, then by rule."""
        accepted = self.all.accepts[self.all.states(data, offsets)]
        places = np.flatnonzero(accepted)
        masks = accepted[places]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in range(len(self.rules)):
            at = places[(masks >> r) & 1 != 0]
            if not len(at):
                continue
            ends = at[np.flatnonzero(np.append(np.diff(at) > 1, True))] + 1
            rows = np.searchsorted(offsets, ends - 1, "right") - 1
            for row in np.unique(rows).tolist():
                base = int(offsets[row])
                text = data[base : offsets[row + 1]].tobytes()
                for start, end in self._matches(r, text, (ends[rows == row] - base).tolist()):
                    m = self.exact[r].fullmatch(text, start, end)
                    if m and len(m[m.lastindex or 0]) >= self.rules[r].least:
                        found.setdefault(row, []).append((start, r, end))
        return {row: [(self.rules[r].kind, s, e) for s, r, e in sorted(spans)] for row, spans in found.items()}

    def _matches(self, r: int, text: bytes, ends: list[int]) -> Iterator[tuple[int, int]]:
        """Leftmost, non-overlapping matches, from the ends found in one pass."""
        after = 0
        for end in ends:
            start = self.back[r].farthest(text, end - 1, -1, -1)
            if start < after:  # it began inside the last match: go on from there
                yield from self._onward(r, text, after)
                return
            yield start, end
            after = end

    def _onward(self, r: int, text: bytes, after: int) -> Iterator[tuple[int, int]]:
        table, classes, accepts, _, width, state, _ = self.one[r]._lists()
        i, open_ = after, False
        while i <= len(text):
            now = table[state * width + classes[text[i]]] if i < len(text) else 0
            on = i < len(text) and accepts[now]
            if open_ and not on:
                start = self.back[r].farthest(text, i - 1, -1, after - 1)
                yield start, i
                after, state, open_ = i, 0, False
                if i == len(text):
                    return
                continue
            open_, state = bool(on), now
            i += 1


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once on the driver; tasks get the arrays (about a megabyte)."""
    return Scanner(rules)


def _code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    if text.isascii():
        return [{"kind": k, "start": s, "end": e} for k, s, e in spans]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"kind": k, "start": int(before[s]), "end": int(before[e])} for k, s, e in spans]


def _scanned(scanner: Scanner, column: pa.Array) -> Iterator[tuple[int, bytes, list]]:
    data, offsets = text_buffer(column)
    for start, stop in slices(offsets, 8 << 20):
        part = data[offsets[start] : offsets[stop]]
        inner = offsets[start : stop + 1] - offsets[start]
        for row, spans in scanner.scan(part, inner).items():
            yield start + row, part[inner[row] : inner[row + 1]].tobytes(), spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every row, in code points,
    ordered by start and then by the rules' order."""
    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[id_col], T.StructField("spans", SPANS)])

    scanner = compiled(rules)

    def scan(batches):
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, text, spans in _scanned(scanner, batch.column(1)):
                found[row] = _code_points(text, spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    return source.mapInArrow(trimmed(scan), schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES, length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping and touching
    spans by one); all columns stay, null texts stay null.  length_col: a long
    column that holds the text's length in characters and follows the change."""
    if length_col and length_col not in docs.columns:
        length_col = None
    docs_columns = docs.columns
    place = docs_columns.index(text_col)
    scanner = compiled(rules)

    def scan(batches):
        for batch in batches:
            column = batch.column(place)
            changed: dict[int, str] = {}
            for row, text, spans in _scanned(scanner, column):
                out, after = [], -1
                for _, s, e in spans:
                    if s > after:
                        out += [text[max(after, 0) : s], mark.encode()]
                    after = max(after, e)
                changed[row] = b"".join([*out, text[after:]]).decode()
            if changed:
                rows = column.to_pylist()
                for row, text in changed.items():
                    rows[row] = text
                batch = batch.set_column(place, batch.schema.field(place), pa.array(rows, column.type))
                if length_col:
                    at = docs_columns.index(length_col)
                    sizes = batch.column(at).to_pylist()
                    for row, text in changed.items():
                        sizes[row] = len(text)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.column(at).type))
            yield batch

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs_columns))])  # names with dots don't pass as they are
    return plain.mapInArrow(trimmed(scan), plain.schema).toDF(*docs_columns)
