"""Sources and sinks: JSON lines, whole JSON objects, judgement tables, manifests,
comparison tables, vector stores and lexical indexes.  Schemas are always given."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from . import json_objects

QRELS = "query_id string, iteration string, doc_id string, gain int"
RANKINGS = "query_id string, results array<struct<doc_id:string,score:double>>"
QA_FILE = "map<string,struct<question:string,answer:string,contexts:map<string,struct<content:string,link:string,document:string,`điều`:string>>>>"
CONTEXT_FILE = "passage string, name string, link string"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object per line; blank lines are skipped, anything else fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Four tab-separated columns, the second ignored; of repeated rows the last in the
    file counts (of several files: the file of the last name).  Rows keep their order
    through the file's blocks: a row's place is its file, its block and its number."""
    rows = spark.read.schema(QRELS).option("sep", "\t").option("mode", "FAILFAST").option("quote", "").csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    keys = ["query_id", "doc_id", *[c for c in rows.columns if c == "split"]]
    placed = rows.select(*keys, "gain", place.alias("place"))
    return placed.groupBy(*keys).agg(F.max_by("gain", "place").alias("gain"))


def write_qrels(qrels: DataFrame, path: str, mode: str = "errorifexists", ordered: bool = True, partition: str | None = None) -> None:
    by = [partition] if partition else []
    rows = qrels.select(*by, "query_id", F.lit("0").alias("iteration"), "doc_id", "gain")
    rows = rows.orderBy(*by, "query_id", "doc_id") if ordered else rows
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).option("sep", "\t").option("quote", "").csv(path)


def read_object_file(spark: SparkSession, path: str, value_schema: str = QA_FILE) -> DataFrame:
    """A JSON file that is one object: (file, key, value) per entry, cut in blocks."""
    return json_objects.read_object_file(spark, path, value_schema)


def read_tree(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, stem, value) of every matching file below a folder, path relative."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    full = files.select("value", F.col("_metadata.file_path").alias("full"))
    root = F.lit(path.rstrip("/") + "/")
    at = F.instr("full", root)  # a folder's name may hold any character
    if "://" not in path:
        full = full.withColumn("full", F.url_decode(F.regexp_replace("full", r"\+", "%2B")))
    inside = F.when(at > 0, F.substr("full", at + F.length(root))).otherwise(F.col("full"))
    return full.select(inside.alias("path"), F.regexp_replace(F.element_at(F.split("full", "/"), -1), r"\.json$", "").alias("stem"), "value")


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern; for the few files of a folder of runs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(s.getPath()) for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []]


def has_known_field(value, fields: list[str]):
    """Whether a JSON object holds one of some fields at least."""
    return F.arrays_overlap(F.json_object_keys(value), F.array(*map(F.lit, fields)))


def structured_documents(tree: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``tree(path, stem, value)``: documents (path, stem, header, sections) and the
    rejected files.  A section is a string or an object with number and title."""
    known = has_known_field(F.col("value"), ["Header", *kinds])
    lists = F.concat(*[
        F.transform(
            F.coalesce(F.from_json(F.get_json_object("value", f"$['{k}']"), "array<string>"), F.array().cast("array<string>")),
            _section(k),
        )
        for k in kinds
    ])
    kept = tree.where(known).select("path", "stem", F.get_json_object("value", "$.Header").alias("header"), lists.alias("sections"))
    return kept, tree.where(~F.coalesce(known, F.lit(False))).select("path", F.lit("no known field").alias("reason"))


def _section(kind: str):
    def one(x):
        is_object = x.startswith("{")
        return F.struct(
            F.lit(kind).alias("kind"), F.when(is_object, F.get_json_object(x, "$.number")).alias("number"),
            F.when(is_object, F.coalesce(F.get_json_object(x, "$.title"), F.lit(""))).alias("title"), F.when(~is_object, x).alias("plain"),
        )

    return one


def lookup_contexts(references: DataFrame, files: DataFrame) -> DataFrame:
    """``references(ref)`` with their context files' columns; a missing file fails."""
    joined = references.join(files, F.col("ref") == F.col("stem"), "left")
    missing = F.raise_error(F.concat(F.lit("context file missing: "), F.col("ref")))
    return joined.withColumn("value", F.when(F.col("value").isNull(), missing).otherwise(F.col("value")))


def write_manifest(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row of counts as one JSON object."""
    counts.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_comparison(rows: DataFrame, columns: list[str], path: str, mode: str = "overwrite") -> None:
    """Chosen columns as a tab-separated table with a header."""
    rows.select(*columns).coalesce(1).write.mode(mode).option("sep", "\t").option("header", "true").csv(path)


def nest_rankings(rankings: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, score) to one row per query, results in order."""
    items = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    return rankings.groupBy("query_id").agg(F.transform(items, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("results"))


def flatten_rankings(nested: DataFrame) -> DataFrame:
    rows = nested.select("query_id", F.posexplode("results").alias("p", "r"))
    return rows.select("query_id", F.col("r.doc_id").alias("doc_id"), F.col("r.score").alias("score"), (F.col("p") + 1).cast("long").alias("rank"))


def config_key(**settings: object) -> str:
    """A short name for a setting, for versioned folders."""
    return hashlib.sha256(repr(sorted(settings.items())).encode()).hexdigest()[:16]


def ensure_vectors(spark: SparkSession, corpus: DataFrame, encode, root: str, key: str) -> DataFrame:
    """The vector store ``root/key``: encodes only ids that it lacks, so an interrupted
    run goes on where it stopped.  ``encode`` takes (doc_id, text) and gives
    (doc_id, embedding); an id without a vector is stored with null.  A store that holds
    ids that the corpus lacks, or an id twice, belongs to another corpus and fails."""
    path = f"{root.rstrip('/')}/{key}"
    schema = f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, embedding array<float>"
    todo = corpus.select("doc_id", T.text_or_empty(F.col("text")).alias("text"))
    if names(spark, path):
        held = spark.read.schema(schema).parquet(path).groupBy("doc_id").agg(F.count("*").alias("n"))
        strange = held.join(corpus.select("doc_id"), "doc_id", "left_anti").select("doc_id").unionAll(held.where("n > 1").select("doc_id")).limit(3).collect()
        if strange:
            raise ValueError(f"the vector store {path} is not of this corpus: {[r[0] for r in strange]}")
        todo = todo.join(held.select("doc_id"), "doc_id", "left_anti")
    if not todo.isEmpty():
        done = todo.select("doc_id").join(encode(todo).select("doc_id", F.col("embedding").cast("array<float>").alias("embedding")), "doc_id", "left")
        done.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).where("embedding is not null")
