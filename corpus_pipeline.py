"""A corpus pipeline of the llm operators, from ``documents`` to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what the stage
before kept, read again from Parquet, and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import mixing, near_dups, packing, quality, secrets
from trailmark.llm.common import materialize
from trailmark.llm.queries import prepare, tokenizer_path

#: The share of all tokens that the mixing stage's sample is expected to hold at least.
LEAST = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.filter_quality(docs)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8)."""
    prepare(spark)
    return near_dups.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    prepare(spark)
    return secrets.redact_secrets(docs, length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights; rare categories don't bring the
    sample below ``LEAST`` of the tokens."""
    prepare(spark)
    return mixing.sampled(docs, least=LEAST)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_dups_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the secret scanner nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
