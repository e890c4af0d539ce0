"""Text functions: Column in, Column out, inside Catalyst but for one."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The word pattern in Java's terms; a word or one punctuation mark.
WORD = r"[\p{L}\p{N}_]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

#: Question words that retrieval leaves out.
STOPWORDS = (
    "ai bao bằng bị bởi cả các cái cần cho chứ chưa có của cùng cũng đã đang đây để đến đều được gì hay khi không là lại lên mà "
    "mỗi một nào này nếu ngay như những ở phải qua ra rằng rất sau sẽ theo thì trên trong trước từ từng và vẫn vào với vừa về do"
).split()

#: Words that section selection leaves out.
SECTION_STOPWORDS = "là và của cho trong với theo được có những nào gì thế như để khi thì phải thực hiện quy định các một".split()

#: Marks that attach to the word before, and to the word after.
NO_SPACE_BEFORE = [",", ".", ";", ":", "!", "?", "%", ")", "]", "}", "»"]
NO_SPACE_AFTER = ["(", "[", "{", "«"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_list(c: Column, fold: str = "none") -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(folded(F.lower(text_or_empty(c)), fold), F.lit(WORD), F.lit(0))


def lexical_terms(c: Column, fold: str = "none") -> Column:
    """Words without stopwords; all words if nothing else is there; folded after that."""
    if fold != "none":
        return F.transform(lexical_terms(c), lambda w: folded(w, fold))
    stop = F.array(*map(F.lit, STOPWORDS))
    return let(word_list(c), lambda w: let(F.filter(w, lambda x: ~F.array_contains(stop, x)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(w)))


def word_mark_tokens(c: Column) -> Column:
    """Words and single punctuation marks in order."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(WORD_OR_MARK), F.lit(0))


def detokenize(tokens: Column) -> Column:
    """Tokens joined by spaces, but for marks that attach to a side."""
    before, after = F.array(*map(F.lit, NO_SPACE_BEFORE)), F.array(*map(F.lit, NO_SPACE_AFTER))

    def step(text: Column, token: Column) -> Column:
        joins = (text == "") | F.array_contains(before, token) | F.array_contains(after, F.right(text, F.lit(1)))
        return F.when(joins, F.concat(text, token)).otherwise(F.concat(text, F.lit(" "), token))

    return F.aggregate(tokens, F.lit(""), step)


def _ascii_map() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII character and marks."""
    left, right = [], []
    for code in range(0xA0, 0x1F00):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalnum():
            left.append(chr(code))
            right.append(plain)
    return "".join(left), "".join(right)


def _fold_map(full: bool) -> tuple[str, str]:
    """Letters that are one letter and marks: all of them, or those with one mark only.
    Marks that stand alone, deleted by ``full``, come last."""
    left, right = [], []
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        marks = [c for c in parts[1:] if unicodedata.combining(c)]
        if len(parts) > 1 and len(marks) == len(parts) - 1 and (full or len(marks) == 1):
            left.append(chr(code))
            right.append(parts[0])
    return "".join(left) + ("".join(map(chr, range(0x300, 0x370))) if full else ""), "".join(right)


FOLDS = ("none", "single", "full")


def folded(c: Column, fold: str = "none") -> Column:
    """Accents dropped: nowhere, from letters with one mark, or from all."""
    if fold not in FOLDS:
        raise ValueError(f"unknown fold {fold!r}")
    return c if fold == "none" else F.translate(c, *_fold_map(fold == "full"))


def slug(c: Column) -> Column:
    """ASCII letters and digits of a text, accents dropped, in lower case."""
    left, right = _ascii_map()
    return F.regexp_replace(F.lower(F.translate(text_or_empty(c), left, right)), "[^a-z0-9]+", "")


def url_stem(url: Column) -> Column:
    """The last path segment without .html or .aspx."""
    path = F.regexp_extract(text_or_empty(url), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?i)\.(?:html|aspx)$", "")


def trailing_id(stem: Column) -> Column:
    """Digits after the last hyphen, or null."""
    return F.nullif(F.regexp_extract(stem, r"-(\d+)$", 1), F.lit(""))


def sentences(c: Column) -> Column:
    """Non-blank sentences: cut after . ! ? and white space, and at line ends."""
    marked = F.regexp_replace(text_or_empty(c), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "[\u0001\n]+", -1), lambda s: F.trim(s)), lambda s: s != "")


def concise_fact(text: Column, question: Column, max_chars: int = 500) -> Column:
    """The two sentences that share most words with the question, best first."""

    def pick(found: Column, terms: Column) -> Column:
        scored = F.transform(found, lambda s, i: F.struct((-F.size(F.array_intersect(terms, word_list(s)))).alias("s"), i.alias("i"), s.alias("t")))
        return F.array_join(F.transform(F.slice(F.array_sort(scored), 1, 2), lambda x: x["t"]), " ")

    chosen = let(F.array_distinct(word_list(question)), lambda q: let(sentences(text), lambda s: F.when(F.size(s) > 0, pick(s, q)).otherwise(text_or_empty(text))))
    return F.substring(chosen, 1, max_chars)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function has."""
    return texts.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def normalized(c: Column) -> Column:
    """Compatibility composed, in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text_or_empty(c))), r"\s+", " "))


def normalized_tokens(c: Column) -> Column:
    return F.filter(F.split(normalized(c), " ", -1), lambda x: x != "")


def subsequence_at(haystack: Column, needle: Column) -> Column:
    """First place (from 0) at which ``needle`` lies in ``haystack``, or null."""
    n, m = F.size(haystack), F.size(needle)
    first = F.get(needle, F.lit(0))  # few places have it, and only there a part is copied
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.get(haystack, i).eqNullSafe(first) & (F.slice(haystack, i + 1, m) == needle))
    return F.when((m > 0) & (m <= n), F.get(places, F.lit(0)))


def answer_fragments(answer: Column) -> Column:
    """Token lists of an answer's pieces, longest first, distinct, two tokens at least.
    The two patterns for what opens a list item are fixed values."""
    pieces = F.split(F.regexp_replace(text_or_empty(answer), r"([.!?;])\s+", "$1\u0001"), "[\u0001\n]+", -1)

    def clean(x: Column) -> Column:
        x = F.trim(F.regexp_replace(x, r"^\s*[-+•*]\s*", ""))
        return F.trim(F.regexp_replace(x, r"^\s*\(?\d+[.)]\s*", ""))

    lists = F.filter(F.array_distinct(F.transform(pieces, lambda x: word_mark_tokens(clean(x)))), lambda t: F.size(t) >= 2)
    keyed = F.array_sort(F.transform(lists, lambda t: F.struct((-F.size(t)).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda x: x["t"])


def stable_seed(id_col: Column, seed: int) -> Column:
    """A seed per id: ``seed`` plus the first 32 bits of its SHA-1."""
    return F.conv(F.substring(F.sha1(id_col.cast("string")), 1, 8), 16, 10).cast("long") + F.lit(seed)


def synthetic_id(content: Column, context: Column) -> Column:
    """The content as id, or one derived from the whole context (a map of strings, read
    in the order of its keys) if it is blank."""
    entries = F.array_sort(F.transform(F.map_entries(context), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    pair = lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.coalesce(F.concat(F.lit('"'), F.regexp_replace(e["value"], r'(["\\\\])', r"\\$1"), F.lit('"')), F.lit("null")))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ", "), F.lit("}"))
    return F.coalesce(F.nullif(F.trim(text_or_empty(content)), F.lit("")), F.concat(F.lit("context_"), F.substring(F.sha1(whole), 1, 16)))
