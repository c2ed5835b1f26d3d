"""Documents to a training mixture.

Stages in order: the quality classifier drops what it rejects; of each group of
near duplicates one document stays; documents contaminated by the benchmark go;
personal data gets surrogates; sources are mixed to equal weights. Each stage
reads what the one before wrote, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import compression_quality, poisson_mixing, surrogates, training_suffixes, vertical_join
from caseloom.llm.common import table
from caseloom.session import checkpoint_root

#: SQL states neither compression nor surrogates; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression_quality.good_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return vertical_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return training_suffixes.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; ``n_chars`` follows the text."""
    changed = surrogates.pseudonymize(docs)
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mixing.mix(docs)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of ``documents``. Stage tables are written to the cluster's checkpoint folder."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
