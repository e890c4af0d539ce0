"""Building the corpus: reference resolution, sections, dedupe, tracks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Section kinds of a structured document, outermost first.
STRUCTURE_KINDS = ("Phần", "Chương", "Mục", "Tiểu Mục", "Điều")
ARTICLE = "Điều"
PREFIX = 50

# ---------------------------------------------------------- resolving references


def with_lookup_keys(documents: DataFrame, stem: Column) -> DataFrame:
    """``numeric_id``, ``slug`` and ``prefix`` of a document's or a reference's stem."""
    out = documents.withColumn("numeric_id", T.trailing_id(stem)).withColumn("slug", T.slug(stem))
    return out.withColumn("prefix", F.substring("slug", 1, PREFIX))


def resolve_references(references: DataFrame, documents: DataFrame) -> DataFrame:
    """``references(ref_id, url)`` to (ref_id, doc_id, tier).

    1: the only document with the url's trailing number; 2: of several, the only one
    whose slug begins the url's or is begun by it; 3: the only such document in the
    bucket of the slug's first 50 characters; else null.  All are equality joins with
    the prefix test as a residual; uniqueness is an aggregate per reference."""
    refs = with_lookup_keys(references.select("ref_id", T.url_stem(F.col("url")).alias("stem")), F.col("stem")).select("ref_id", "numeric_id", "slug", "prefix")
    docs = with_lookup_keys(documents.select("doc_id", "stem"), F.col("stem")).select(F.col("doc_id"), F.col("numeric_id").alias("dn"), F.col("slug").alias("ds"), F.col("prefix").alias("dp"))
    slug_match = F.col("ds").startswith(F.col("slug")) | F.col("slug").startswith(F.col("ds"))
    by_number = refs.join(docs, F.col("numeric_id") == F.col("dn")).groupBy("ref_id").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("only"), F.count_if(slug_match).alias("m"), F.min(F.when(slug_match, F.col("doc_id"))).alias("match")
    )
    by_prefix = refs.join(docs, (F.col("prefix") == F.col("dp")) & slug_match).groupBy("ref_id").agg(F.count("*").alias("p"), F.min("doc_id").alias("near"))
    joined = refs.select("ref_id").join(by_number, "ref_id", "left").join(by_prefix, "ref_id", "left")
    tier = F.when(F.col("n") == 1, 1).when(F.col("m") == 1, 2).when(F.col("p") == 1, 3)
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("match")).when(F.col("p") == 1, F.col("near"))
    return joined.select("ref_id", chosen.alias("doc_id"), tier.cast("long").alias("tier"))


def all_or_nothing(sample_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sample_refs(sample_id, pos, url, doc_id)``: samples whose references are all
    resolved (sample_id, doc_ids in first-seen order), and the rest with a reason."""
    missing = F.array_sort(F.collect_list(F.when(F.col("doc_id").isNull(), F.struct("pos", "url"))))
    grouped = sample_refs.groupBy("sample_id").agg(
        F.transform(missing, lambda x: x["url"]).alias("missing_links"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("pos", "doc_id")))), lambda x: x["doc_id"])).alias("doc_ids"),
    )
    kept = grouped.where(F.size("missing_links") == 0).select("sample_id", "doc_ids")
    dropped = grouped.where(F.size("missing_links") > 0).select("sample_id", F.lit("missing_structured_context").alias("reason"), "missing_links")
    return kept, dropped


# ---------------------------------------------------------------------- sections


def format_section(kind: Column, number: Column, title: Column, plain: Column) -> Column:
    """A string section below its kind; a numbered one as ``kind number. title``."""
    heading = F.when(number.isNotNull(), F.concat(kind, F.lit(" "), number)).otherwise(kind)
    return F.when(plain.isNotNull(), F.concat(kind, F.lit("\n"), plain)).otherwise(F.trim(F.concat(heading, F.lit(". "), F.coalesce(title, F.lit("")))))


def _is(name: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == name


def flatten_document(header: Column, sections: Column) -> Column:
    """Header and ``sections`` (array of struct kind, number, title, plain) in the
    fixed order of kinds, joined by blank lines; empty parts are left out."""
    parts = [F.array(F.trim(T.text_or_empty(header)))]
    for name in STRUCTURE_KINDS:
        own = F.filter(sections, _is(name))
        parts.append(F.transform(own, lambda s: F.trim(format_section(s["kind"], s["number"], s["title"], s["plain"]))))
    return F.array_join(F.filter(F.concat(*parts), lambda x: x != ""), "\n\n")


def find_article(sections: Column, number: Column) -> Column:
    """``Điều n. title`` of the first article with the number, or null."""
    own = F.filter(sections, lambda s: (s["kind"] == ARTICLE) & (s["number"] == number))
    return T.let(F.get(own, F.lit(0)), lambda s: F.when(s.isNotNull(), F.trim(F.concat(F.lit(f"{ARTICLE} "), number, F.lit(". "), F.coalesce(s["title"], F.lit(""))))))


def corpus_records(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``requests(source_id, article)`` against ``documents(source_id, path, title, url,
    header, sections)``: passages, with the full document where the article is absent
    (which keeps its article id)."""
    return passage_records(requests.join(documents, "source_id"))


def passage_records(rows: DataFrame, *more: str) -> DataFrame:
    """The same of ``rows(article, path, title, url, header, sections)``, with columns
    ``more`` kept."""
    section = rows.withColumn("found", find_article(F.col("sections"), F.col("article")))
    has_number = F.coalesce(F.col("article"), F.lit("")) != ""
    return section.select(
        *more, F.when(has_number, F.concat("path", F.lit("#dieu="), "article")).otherwise(F.concat("path", F.lit("#document"))).alias("doc_id"),
        F.coalesce("found", flatten_document(F.col("header"), F.col("sections"))).alias("text"),
        "title", "url", F.col("path").alias("source_file"),
        F.when(F.col("found").isNotNull(), "article").otherwise("document").alias("section_type"),
        F.col("article").alias("section_number"),
    )


def global_corpus(own: DataFrame, gold: DataFrame) -> DataFrame:
    """One record per id, gold before own, then the first seen (``pos``); title and url
    fall back to the first that is not empty."""
    together = gold.withColumn("p", F.lit(0)).unionByName(own.withColumn("p", F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("p", "pos")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = lambda c: F.first(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(every)
    return together.withColumn("r", F.row_number().over(order)).withColumn("title", full("title")).withColumn("url", full("url")).where("r = 1").drop("r", "p")


def related_sections(contexts: DataFrame, sections: DataFrame) -> DataFrame:
    """``contexts(ctx_id, doc_id, question)`` and ``sections(doc_id, pos, number,
    title)``: the section with most shared words, heading words counting twice more;
    the first of equals, none without a shared word."""
    stop = F.array(*map(F.lit, T.SECTION_STOPWORDS))
    terms = F.filter(F.array_distinct(T.word_list(F.col("question"))), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    asked = contexts.select("ctx_id", "doc_id", terms.alias("terms"))
    heading = F.get(F.split(T.text_or_empty(F.col("title")), "\n", -1), F.lit(0))
    shared = lambda c: F.size(F.array_intersect("terms", T.word_list(c)))
    scored = asked.join(sections, "doc_id").withColumn("score", (shared(F.col("title")) + 2 * shared(heading)).cast("long")).where("score > 0")
    order = Window.partitionBy("ctx_id").orderBy(F.desc("score"), "pos")
    best = scored.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("ctx_id", "doc_id", "number", F.trim(F.concat(F.lit(f"{ARTICLE} "), "number", F.lit(". "), F.trim(F.col("title")))).alias("text"), "score")


# ------------------------------------------------------------------------ tracks


def min_contexts(samples: DataFrame, least: int = 2) -> DataFrame:
    """Samples with at least ``least`` contexts (array or map column ``contexts``)."""
    return samples.where(F.size("contexts") >= least)


def filter_track(qrels: DataFrame, track: str = "true_multihop") -> DataFrame:
    """``all_matched``: everything; ``true_multihop``: the judgements of queries with two
    relevant documents or more."""
    if track == "all_matched":
        return qrels
    if track != "true_multihop":
        raise ValueError(f"unknown track {track!r}")
    many = qrels.groupBy("query_id").agg(F.count_if(F.col("gain") > 0).alias("n")).where("n >= 2").select("query_id")
    return qrels.join(many, "query_id", "left_semi")


def drop_key(metadata: Column, key: str) -> Column:
    return F.map_filter(metadata, lambda k, v: k != key)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
