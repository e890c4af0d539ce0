"""A lexical index that is kept between runs.

``root/v{n}`` is a version: the postings that it added, partitioned by term bucket and
sorted by term; the live passages with digest and run (the version that holds their
postings); passages whose postings no longer count; the vocabulary of what is live;
and, written last, ``state``.  Opening the index with the corpus that it was made of
costs one pass over the corpus for its fingerprint.  If the corpus has changed, only
new and changed passages are cut into words: their postings are a further run, and
postings of changed and vanished passages are left out by an anti-join.  After several
runs, or when more is dead than alive, the index is written anew as one run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.lexical import PASSAGES, LexicalIndex, build_index, count_terms
from .files import names

STATE = "fold string, buckets int, digest string, runs array<int>, dead boolean"
CONTENT = ["doc_id", "title", "text"]


def _versions(spark: SparkSession, root: str) -> list[int]:
    done = names(spark, f"{root}/v*/state/_SUCCESS")
    return sorted(int(path.split("/")[-3][1:]) for path in done)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


class LexicalStore:
    """The index below ``root``; the types of ids are those of the corpus it is opened with."""

    def __init__(self, spark: SparkSession, root: str, id_type: str, most_runs: int = 8) -> None:
        self.spark, self.root, self.most_runs = spark, root.rstrip("/"), most_runs
        self.postings = f"term string, doc_id {id_type}, tf_title long, tf_text long, length long, bucket int"
        self.passages = f"doc_id {id_type}, digest string, run int"
        self.dead = f"doc_id {id_type}, run int"

    def state(self) -> tuple[int, dict] | None:
        """The newest complete version and its state."""
        done = _versions(self.spark, self.root)
        if not done:
            return None
        return done[-1], json.loads(self.spark.read.text(f"{self.root}/v{done[-1]}/state").first()[0])

    def index(self, version: int, state: dict) -> LexicalIndex:
        runs = None
        for run in state["runs"]:
            one = _read(self.spark, f"{self.root}/v{run}/postings", self.postings)
            if state["dead"]:
                one = one.withColumn("run", F.lit(run))
            runs = one if runs is None else runs.unionByName(one)
        if state["dead"]:
            runs = runs.join(_read(self.spark, f"{self.root}/v{version}/dead", self.dead), ["doc_id", "run"], "left_anti").drop("run")
        vocabulary = _read(self.spark, f"{self.root}/v{version}/vocabulary", "term string, df long, bucket int")
        return LexicalIndex(runs, vocabulary, state["fold"], state["buckets"], True)

    def add(self, passages: DataFrame, version: int, fold: str, buckets: int) -> DataFrame:
        """The postings of passages as a run."""
        path = f"{self.root}/v{version}/postings"
        rows = build_index(passages, fold, buckets).postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id")
        rows.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
        return _read(self.spark, path, self.postings)

    def finish(self, version: int, vocabulary: DataFrame, passages: DataFrame, dead: DataFrame | None, **state: object) -> LexicalIndex:
        base = f"{self.root}/v{version}"
        vocabulary.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/vocabulary")
        passages.write.mode("overwrite").parquet(f"{base}/passages")
        if dead is not None:
            dead.write.mode("overwrite").parquet(f"{base}/dead")
        whole = {**state, "dead": dead is not None}
        self.spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/state")
        return self.index(version, whole)


def _digests(passages: DataFrame) -> DataFrame:
    return passages.select("doc_id", audit.exact_digest(["title", "text"]).alias("digest"))


def open_index(passages: DataFrame, root: str, fold: str = "none", buckets: int = 64, most_runs: int = 8) -> LexicalIndex:
    """The index of ``passages(doc_id, title, text)``, ids being unique, below ``root``: as it
    is, if it is of this content and these settings; else extended or built."""
    spark = passages.sparkSession
    passages = passages.select(*CONTENT)
    store = LexicalStore(spark, root, passages.schema["doc_id"].dataType.simpleString(), most_runs)
    digest = audit.table_fingerprint(passages, CONTENT).first()["digest"]
    found = store.state()
    settings = {"fold": fold, "buckets": buckets}
    if found and all(found[1][k] == v for k, v in settings.items()):
        if found[1]["digest"] == digest:
            return store.index(*found)
        extended = _extend(store, passages, *found, digest)
        if extended:
            return extended
    version = found[0] + 1 if found else 0
    postings = store.add(passages, version, fold, buckets)
    return store.finish(version, count_terms(postings), _digests(passages).withColumn("run", F.lit(version)), None, **settings, digest=digest, runs=[version])


def _extend(store: LexicalStore, passages: DataFrame, version: int, state: dict, digest: str) -> LexicalIndex | None:
    """The next version of an index whose corpus has changed; none if it is time to build
    it anew."""
    now = version + 1
    if len(state["runs"]) >= store.most_runs:
        return None
    base, held = f"{store.root}/v{now}", _read(store.spark, f"{store.root}/v{version}/passages", store.passages)
    both = _digests(passages).withColumnRenamed("digest", "new").join(held, "doc_id", "full_outer")
    both.write.mode("overwrite").parquet(f"{base}/compared")
    both = store.spark.read.schema(both.schema).parquet(f"{base}/compared")
    changed = ~F.col("new").eqNullSafe(F.col("digest"))
    fresh = both.where(changed & F.col("new").isNotNull()).select("doc_id")
    gone = both.where(changed & F.col("digest").isNotNull()).select("doc_id", "run")
    dead = gone.unionByName(_read(store.spark, f"{store.root}/v{version}/dead", store.dead)) if state["dead"] else gone
    counts = both.agg(F.count("new").alias("live"), F.count_if(changed & F.col("digest").isNotNull()).alias("gone")).first()
    n_dead = dead.count() if state["dead"] else counts["gone"]
    if n_dead > counts["live"]:
        return None
    postings = store.add(passages.join(fresh, "doc_id", "left_semi"), now, state["fold"], state["buckets"])
    terms = _read(store.spark, f"{store.root}/v{version}/vocabulary", "term string, df long, bucket int").select("bucket", "term", "df").unionByName(count_terms(postings))
    if counts["gone"]:
        before = store.index(version, state).postings.where(F.col("bucket") != PASSAGES).join(gone.select("doc_id"), "doc_id", "left_semi")
        terms = terms.unionByName(count_terms(before).withColumn("df", -F.col("df")))
    vocabulary = terms.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    live = both.where("new is not null").select("doc_id", F.col("new").alias("digest"), F.when(changed, F.lit(now)).otherwise(F.col("run")).alias("run"))
    return store.finish(now, vocabulary, live, dead if n_dead else None, fold=state["fold"], buckets=state["buckets"], digest=digest, runs=[*state["runs"], now])
