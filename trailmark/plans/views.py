"""The retrieval tables that the driver's tables stand for, in Spark and in SQL.

passages: documents, the first line as title; queries: benchmark items; judgements:
a document that holds an item's text; QA samples: conversations; structured pages:
the headings and paragraphs of raw pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)").alias("text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment judgements: a text that holds an item's text holds its longest inner
    word, by which the two are joined before the test.  Items of fewer than three words
    have no word that must be whole and are tested everywhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    words = T.word_list(F.col("text"))
    inner = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    items = queries(spark, sf_dir).select("query_id", "text", F.array_max(inner)["w"].alias("word"))
    keyed = items.where("word is not null")
    found = docs.select("doc_id", F.explode(F.array_distinct(T.word_list(F.col("body")))).alias("word")).join(keyed.select("query_id", "word"), "word")
    likely = docs.join(found.select("query_id", "doc_id"), "doc_id").join(keyed.select("query_id", "text"), "query_id")
    short = docs.join(items.where("word is null").select("query_id", "text"), F.contains("body", "text"))
    return likely.where(F.contains("body", "text")).select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id")).withColumn("gain", F.lit(1))


def graded_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("g"))
    return qrels(spark, sf_dir).join(labels, "doc_id", "left").select("query_id", "doc_id", F.coalesce("g", F.lit(1)).alias("gain"))


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question, doc_ids) in the order of ids."""
    grouped = qrels(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    return grouped.join(queries(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches take as queries the rows whose id is divisible by 20."""
    return vectors(spark, sf_dir).where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def token_vectors(df: DataFrame, out: str, parts: int = 4) -> DataFrame:
    """A vector as ``parts`` token vectors."""
    size = F.size("v") / parts
    tokens = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("v", (i * size).cast("int") + 1, size.cast("int")))
    return df.withColumn(out, tokens).drop("v")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def qa_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question, answer): first user turn, last assistant turn."""
    t = turns(spark, sf_dir)
    user = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    assistant = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    return t.groupBy(F.col("conv_id").alias("query_id")).agg(user["text"].alias("question"), assistant["text"].alias("answer"))


def qa_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, ctx, doc_id, text): the assistant turns."""
    t = turns(spark, sf_dir).where("role = 'assistant'")
    return t.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ctx"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, header, paragraphs): the heading and paragraphs of each page."""
    pages = table(spark, sf_dir, "pages")
    strip = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    header = strip(F.regexp_extract("html", "<h1>([^\n]*?)</h1>", 1))
    paragraphs = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select(F.col("page_id").alias("doc_id"), "url", header.alias("header"), paragraphs.alias("paragraphs"))


#: The same in DuckDB SQL.
SQL = {
    "passages": "passages AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS text FROM documents)",
    "queries": "queries AS (SELECT item_id AS query_id, text FROM benchmark)",
    "qrels": "qrels AS MATERIALIZED (SELECT b.item_id AS query_id, d.doc_id, 1 AS gain FROM benchmark b JOIN documents d ON contains(d.text, b.text))",
    "positives": "positives AS (SELECT query_id, any_value(q.text) AS question, list(r.doc_id ORDER BY r.doc_id) AS doc_ids FROM qrels r JOIN queries q USING (query_id) GROUP BY query_id)",
    "qa": "qa AS (SELECT conv_id AS query_id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id)",
    "ctx": "ctx AS (SELECT conv_id AS query_id, turn AS ctx, conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE role = 'assistant')",
    "sections": r"""sections AS (SELECT page_id AS doc_id, url, trim(regexp_replace(regexp_extract(html, '<h1>([^\n]*?)</h1>', 1), '<[^>]*>', '', 'g')) AS header,
        list_filter(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: trim(x)), lambda x: x <> '') AS paragraphs FROM pages)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
