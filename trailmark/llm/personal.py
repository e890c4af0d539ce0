"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, a plus before a digit, a dot
between digits, eight digits in a row (each with one separator or none before
it), scheme marks and identifier cues.  It runs over the bytes with A-Z as a-z
and every digit as 0, so that a class of characters is one pattern.  From every
anchor a parser reads to the left and to the right, as far as its kind allows,
and validates what it found: number ranges, counts of digits, check digits.
Text without anchors is never parsed.

Each kind's spans are leftmost and do not overlap; a candidate that fails its
test is dropped, and the search goes on behind it.

Defined results: a null or empty text has no spans; rows are independent, so
repeated rows, and rows without an id, get results of their own; positions are
code points, end exclusive; a text is read whole, however long: anchors in
pieces that overlap by the longest pattern, parsers on all of it, each in linear
time; other columns of any name may stand beside id and text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_buffer, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
#: Beyond the base: what stands behind a cue and passes its check, and logins in addresses.
MORE_KINDS = ("iban", "ssn", "account", "login")
KINDS = BASE_KINDS + MORE_KINDS
#: Words that announce a number.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "passport": "account", "konto": "account", "compte": "account", "cuenta": "account"}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
PIECE = 1 << 20

_DIGITS, _LOCAL = b"0123456789", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_CLASSES = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NAMED = rb"(?:\x20?(?:number|no|nr|num|code|id))?[.:#=\x20]{0,4}"
_IBAN = re.compile(_NAMED + rb"([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})")
_SSN = re.compile(_NAMED + rb"(?:is\x20)?([0-9]{3}([\x20-])[0-9]{2}\2[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(_NAMED + rb"([A-Za-z]{0,3}[0-9]{6,18})(?![A-Za-z0-9])")
_LOGIN = re.compile(rb"([A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=:-]+)@[A-Za-z0-9\[]")


@lru_cache(maxsize=1)
def _anchors() -> tuple[ahocorasick.Automaton, int]:
    """The automaton and the length of its longest pattern; built once in every worker."""
    words = {"@": "email", "0.0": "ip", "+0": "phone", "://": "login", **CUES}
    words |= {"0" + "".join(s + "0" for s in between): "card" for between in product(("", " ", "-"), repeat=7)}
    found = ahocorasick.Automaton()
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found, max(map(len, words))


def anchors(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of every anchor by kind, by end."""
    automaton, longest = _anchors()
    out: dict[str, list[tuple[int, int]]] = {}
    for at in range(0, len(text), PIECE):
        first = max(at - longest + 1, 0)
        for end, (kind, size) in automaton.iter(text[first : at + PIECE].translate(_CLASSES).decode("latin-1")):
            if first + end >= at:
                out.setdefault(kind, []).append((first + end + 1 - size, first + end + 1))
    return out


def _left(text: bytes, at: int, stop: int, of: bytes) -> int:
    """Where the run of bytes of a set begins that ends before ``at``, not before ``stop``."""
    size = 64
    while at > stop:
        low = max(stop, at - size)
        rest = len(text[low:at].rstrip(of))
        if rest:
            return low + rest
        at, size = low, size * 2
    return at


def _emails(text: bytes, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    after = 0
    for at, _ in found:
        domain = _DOMAIN.match(text, at)
        start = _left(text, at, after, _LOCAL) if domain else at
        if start < at:
            after = domain.end()
            yield start, after


def _ips(text: bytes, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    after = 0
    for first, _ in found:
        if first < after:
            continue
        start = _left(text, first + 1, after, _DIGITS)
        m = _IP.match(text, start)
        if m:
            after = m.end()
            parts = [p.lstrip(b"0") for p in m[0].split(b".")]
            if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                yield start, after


def luhn(digits: bytes) -> bool:
    odd = sum(digits[-1::-2]) - 48 * len(digits[-1::-2])
    return (odd + sum(sum(divmod(2 * (d - 48), 10)) for d in digits[-2::-2])) % 10 == 0


def _cards(text: bytes, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    after = 0
    for _, end in found:
        if end <= after:
            continue
        start = _left(text, end, after, _DIGITS)
        while start - 2 >= after and text[start - 1] in b" -" and text[start - 2] in _DIGITS:
            start = _left(text, start - 1, after, _DIGITS)
        m = _CARD.match(text, start)
        after = m.end()
        digits = m[0].translate(None, b" -")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield start, after


def _phones(text: bytes, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for start, _ in found:
        m = _PHONE.match(text, start)
        if m and 8 <= len(m[0].translate(None, b" ().-+")) <= 15:
            yield start, m.end()


def _behind(text: bytes, found: list[tuple[int, int]], pattern: re.Pattern, valid: Callable[[bytes], int]) -> Iterator[tuple[int, int]]:
    """What stands behind a cue that is a word of its own; ``valid`` tells how much of it counts."""
    after = 0
    for start, end in found:
        if end < after or text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
            continue
        m = pattern.match(text, end)
        size = valid(m[1]) if m else 0
        if size:
            after = m.start(1) + size
            yield m.start(1), after


def iban_size(x: bytes) -> int:
    """The first length at which a word ends and the check digits fit."""
    kept = bytearray()
    for i, b in enumerate(x):
        if b != 32:
            kept.append(b)
        if 15 <= len(kept) <= 34 and b != 32 and not x[i + 1 : i + 2].isalnum():
            moved = (bytes(kept[4:]) + bytes(kept[:4])).decode().upper()
            if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
                return i + 1
    return 0


def _ssn_size(x: bytes) -> int:
    return len(x) if x[:3] not in (b"000", b"666") and x[:1] != b"9" and x[4:6] != b"00" and x[7:] != b"0000" else 0


def _logins(text: bytes, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for start, end in found:
        m = _LOGIN.match(text, end) if text[start - 1 : start].isalnum() else None
        if m:
            yield m.span(1)


_PARSERS: dict[str, Callable[[bytes, list[tuple[int, int]]], Iterator[tuple[int, int]]]] = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": lambda t, f: _behind(t, f, _IBAN, iban_size),
    "ssn": lambda t, f: _behind(t, f, _SSN, _ssn_size), "account": lambda t, f: _behind(t, f, _ACCOUNT, len), "login": _logins,
}


def scan(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by kind as listed, then by start."""
    found = anchors(text)
    return [(kind, s, e) for kind in KINDS if kind in found for s, e in _PARSERS[kind](text, found[kind])]


def code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans in code points, counted between their borders."""
    if not spans or text.isascii():
        return spans
    data = np.frombuffer(text, np.uint8)
    borders = sorted({x for _, s, e in spans for x in (s, e)})
    counts = [int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)) for a, b in zip([0, *borders], borders)]
    before = np.cumsum(counts).tolist()
    at = lambda x: before[bisect_left(borders, x)]
    return [(k, at(s), at(e)) for k, s, e in spans]


def _scanned(column: pa.Array) -> Iterator[tuple[int, bytes, list[tuple[str, int, int]]]]:
    data, offsets = text_buffer(column)
    for row in range(len(offsets) - 1):
        text = data[offsets[row] : offsets[row + 1]].tobytes()
        spans = scan(text)
        if spans:
            yield row, text, spans


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every row, by kind as listed, then by start."""
    source = docs.select(id_col, text_col)
    schema = T.StructType([T.StructField("id", source.schema[0].dataType), T.StructField("spans", SPANS)])

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, text, spans in _scanned(batch.column(1)):
                found[row] = [{"kind": k, "start": s, "end": e} for k, s, e in code_points(text, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    return source.toDF("id", "text").mapInArrow(trimmed(run), schema).toDF(id_col, "spans")


def redact_personal(docs: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with every span replaced by its kind's mark, overlapping ones by the mark of
    the first; all columns stay, null texts stay null."""
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            changed: dict[int, str] = {}
            for row, text, spans in _scanned(column):
                out, after = [], 0
                for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= after:
                        out += [text[after:s], mark.format(kind).encode()]
                    after = max(after, e)
                changed[row] = b"".join([*out, text[after:]]).decode()
            if changed:
                rows = column.to_pylist()
                for row, text in changed.items():
                    rows[row] = text
                batch = batch.set_column(place, batch.schema.field(place), pa.array(rows, column.type))
            yield batch

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots don't pass as they are
    return plain.mapInArrow(trimmed(run), plain.schema).toDF(*names)
