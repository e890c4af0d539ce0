"""The registered queries of the llm operators: thin uses of them with production
parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts fit a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- 1: mixing

_WORD = r"[^\x20\x09-\x0D]+"


def _mix_sql(rounds: int = 25) -> str:
    from .mixing import DIMENSIONS, POWERS

    steps, last = [], "s0"
    for r in range(rounds):
        for d in DIMENSIONS:
            now = f"s{r}_{d}"
            steps.append(f"{now} AS MATERIALIZED (SELECT s.source, s.lang, s.topic, s.tokens, s.w * t.want / sum(s.w) OVER (PARTITION BY s.{d}) AS w FROM {last} s JOIN t_{d} t ON t.k = s.{d})")
            last = now
    wants = [
        f"t_{d} AS MATERIALIZED (SELECT k, want / sum(want) OVER () AS want FROM (SELECT {d} AS k, pow(sum(w), {POWERS[d]}) AS want FROM s0 GROUP BY {d}))" for d in DIMENSIONS
    ]
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS symbols
  FROM documents),
docs AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens,
    CASE WHEN symbols * 10 > n_tokens THEN 'markup' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 600 THEN 'medium' ELSE 'long' END AS topic FROM d),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
s0 AS MATERIALIZED (SELECT *, tokens::DOUBLE / sum(tokens) OVER () AS w FROM cells WHERE tokens > 0),
{", ".join(wants)},
{", ".join(steps)},
rated AS (SELECT *, (w / tokens) / max(w / tokens) OVER () AS p FROM {last})
SELECT docs.doc_id, docs.source, docs.lang, docs.topic, docs.n_tokens, round(coalesce(r.w, 0), 6) AS cell_weight, round(coalesce(r.p, 1), 6) AS probability,
  ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < coalesce(r.p, 1) AS sampled
FROM docs LEFT JOIN rated r ON r.source = docs.source AND r.lang = docs.lang AND r.topic = docs.topic
"""


@query("op1_mix_sources", _mix_sql())
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("__tm_source").alias("source"), F.col("__tm_lang").alias("lang"), F.col("__tm_topic").alias("topic"), F.col("__tm_tokens").alias("n_tokens"),
        F.round("__tm_weight", 6).alias("cell_weight"), F.round("__tm_probability", 6).alias("probability"), F.col("__tm_sampled").alias("sampled"),
    )


# ----------------------------------------------------------- 3: url filters

#: A dated list: (list, domain, action, day).
URL_LIST = (
    ("block", "casino-win.example.com", "add", "2024-01-10"),
    ("block", "free-bets.example.com", "add", "2024-02-01"),
    ("block", "free-bets.example.com", "remove", "2024-06-15"),
    ("block", "free-bets.example.com", "add", "2024-09-01"),
    ("block", "cheap-pills.example.com", "add", "2023-05-01"),
    ("block", "ads-track.example.com", "add", "2024-03-20"),
    ("allow", "www.ads-track.example.com", "add", "2024-07-01"),
    ("allow", "www.ads-track.example.com", "remove", "2024-10-01"),
    ("block", "tionsh.example.com", "add", "2024-04-01"),
    ("block", "tionsh.example.com", "remove", "2024-04-30"),
    ("block", "example.net", "add", "2024-12-01"),
    ("allow", "m.ththth.example.net", "add", "2024-01-01"),
)
_LIST_SQL = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in URL_LIST)


@query(
    "op3_url_filter",
    rf"""
WITH e(list, domain, action, day) AS (VALUES {_LIST_SQL}),
v AS (SELECT list, domain, action, day AS f, lead(day) OVER (PARTITION BY list, domain ORDER BY day, action) AS t FROM e),
p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/:?#]+)', 1)) AS host,
  (DATE '2024-01-01' + (page_id % 366)::INTEGER)::DATE AS fetched FROM pages),
m AS (SELECT p.page_id, v.domain, v.list, row_number() OVER (PARTITION BY p.page_id, p.host ORDER BY length(v.domain) DESC, v.list DESC) AS r
  FROM p JOIN v ON (rtrim(p.host, '.') = v.domain OR NOT starts_with(p.host, '[') AND ends_with(rtrim(p.host, '.'), '.' || v.domain)) AND v.action = 'add' AND v.f <= p.fetched AND (v.t IS NULL OR p.fetched < v.t))
SELECT p.page_id, p.host, p.fetched::VARCHAR AS fetched, m.domain, m.list AS verdict, coalesce(m.list, '') <> 'block' AS kept
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
""",
)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    entries = spark.sql(f"SELECT * FROM VALUES {_LIST_SQL} AS e(list, domain, action, at)")
    captures = table(spark, sf_dir, "pages").withColumn("fetched", F.expr("date_add(DATE '2024-01-01', cast(page_id % 366 as int))"))
    return filter_urls(captures, entries).withColumn("fetched", F.col("fetched").cast("string"))


# --------------------------------------------------------- 5: quality rules


@query(
    "op5_quality_rules",
    rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS g, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < n_words * 2 OR word_chars > n_words * 25 OR n_symbols * 10 > n_words * 4 OR n_dup_lines * 10 > n_lines * 4) AS kept
FROM b
""",
)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


# --------------------------------------------------------------- 6: packing


@query("op6_pack")
def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


# --------------------------------------------------------------- 7: secrets


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


# -------------------------------------------------------- 9: near duplicates


@query(
    "op9_near_dups",
    rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS MATERIALIZED (
  SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.g) AS r
  FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) f USING (g) JOIN n USING (doc_id)),
p AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * a.r <= 15 * a.n + 100 AND 100 * b.r <= 15 * b.n + 100 AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
c AS (SELECT p.x, p.y, p.nx, p.ny, count(*) AS c FROM p JOIN s a ON a.doc_id = p.x JOIN s b ON b.doc_id = p.y AND b.g = a.g GROUP BY ALL),
l AS MATERIALIZED (
  SELECT x AS a, y AS b FROM c WHERE 100 * c >= 85 * (nx + ny - c) UNION ALL SELECT y, x FROM c WHERE 100 * c >= 85 * (nx + ny - c)),
reach(doc_id, other) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""",
)
def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity=85).drop("row")


# -------------------------------------------------------------- 2: lm scoring


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts, train

    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs))


# ------------------------------------------------------- 10: substring dedup


@query(
    "op10_substring_dedup",
    rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM w WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS m FROM g GROUP BY h),
hit AS MATERIALIZED (SELECT g.doc_id, g.i FROM g JOIN f USING (h) WHERE f.m < g.doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM hit, (SELECT unnest(range(50)) AS j)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM gone) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_index import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


# --------------------------------------------------------- 8: suffix dedup


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_suffixes

    return dedup_suffixes(table(spark, sf_dir, "documents")).drop("kept")


# ------------------------------------------------------ 4: nearest neighbours


@query("op4_nearest")
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# --------------------------------------------- 11: conversation structure repair


def _repair_sql() -> str:
    """Costs and edits behind every row, from the last row on: for each state the cheapest
    (cost, letters, lines), which is the least by cost, then by letters."""

    def written(role: str, text: str, behind: str) -> str:
        return f"{{'c': {{c}} + {behind}.c, 'a': '{{l}}' || {behind}.a, 'r': [{role} || ':' || {text}] || {behind}.r}}"

    def arc(letter: str, cost: str, role: str, text: str, behind: str) -> str:
        return written(role, text, behind).replace("{c}", cost).replace("{l}", letter)

    def least(options: list[str]) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    far = "{'c': 1000000000000, 'a': '~', 'r': []::VARCHAR[]}"
    nxt = {"p": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "'user'", "a": "'assistant'"}

    def read(q: str) -> str:  # arcs that read the row
        options = [f"{{'c': 3 + {q}.c, 'a': 'D' || {q}.a, 'r': {q}.r}}"]
        moves = {"p": "su", "s": "u", "u": "a", "a": "u"}[q]
        for initial in moves:
            kept = arc("K", "cut", "role", "text", initial)
            options.append(f"CASE WHEN NOT gone AND substr(role, 1, 1) = '{initial}' THEN {kept} ELSE {far} END")
        options.append(f"CASE WHEN NOT gone THEN {arc('R', '(2 + cut)', name[nxt[q]], 'text', nxt[q])} ELSE {far} END")
        return least(options)

    def inserted(q: str) -> str:  # with insertions before it
        return least([q, arc("I", "2", name[nxt[q]], "''", nxt[q])])

    none = "{'c': 0, 'a': '', 'r': []::VARCHAR[]}"
    user_end = "{'c': 2, 'a': 'I', 'r': ['assistant:']}"
    system_end = "{'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']}"
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
fate AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fate FROM conversations, t),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, fate FROM fate WHERE fate <> 0),
twice AS (SELECT conv_id, turn, role, text FROM hurt UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE fate = 3),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM twice),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS bare, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows_ AS MATERIALIZED (SELECT *, bare OR again AS gone, (NOT bare AND NOT again AND NOT regexp_matches(text, '[.!?]{space}*$'))::BIGINT AS cut FROM seen),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bare) AS blank, count(*) FILTER (again AND NOT bare) AS duplicate, sum(cut) AS truncated,
  count(*) FILTER (before IS NOT NULL AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
walk(conv_id, i, p, s, u, a) AS (
  SELECT conv_id, n, {none}, {system_end}, {user_end}, {none} FROM stats
  UNION ALL
  SELECT conv_id, i - 1, {inserted('p')}, {inserted('s')}, u, {inserted('a')} FROM (
    SELECT conv_id, i, p, s, {inserted('u')} AS u, a FROM (
      SELECT w.conv_id, w.i, {read('p')} AS p, {read('s')} AS s, {read('u')} AS u, {read('a')} AS a
      FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i))),
done AS (SELECT conv_id, p.c AS cost, p.a AS audit, sha256(array_to_string(p.r, chr(10))) AS sha FROM walk WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_conversation_repair", _repair_sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, report

    turns = table(spark, sf_dir, "conversations")
    return report(damage(turns), turns)


# --------------------------------------------------- 12: ranked lexical search

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op12_lexical_search",
    rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
p AS MATERIALIZED (SELECT term, r, any_value(doc_id) AS doc_id, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY term, r),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS tokens FROM d),
v AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, docs),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)) GROUP BY ALL),
m AS (SELECT i, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens))))::BIGINT AS score FROM q JOIN v USING (term) JOIN p USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM m WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
""",
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impacts import build_index, search

    return search(table(spark, sf_dir, "benchmark"), build_index(table(spark, sf_dir, "documents")))


# ------------------------------------------------------------ 13: personal data


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal import BASE_KINDS, find_personal

    found = find_personal(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
