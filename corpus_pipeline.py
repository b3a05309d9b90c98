"""The corpus pipeline: five stages over ``documents``.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``. Models are learned from what the
stage is given: the language from its rows' ``lang``, quality from ``labels``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import load
from eventide.llm.langid import keep_identified
from eventide.llm.packing import packing
from eventide.llm.pii import redact
from eventide.llm.quality_nn import keep_good
from eventide.llm.simhash import keep_first
from eventide.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified with a posterior of 0.5 or more."""
    return keep_identified(spark, docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores 0.3 or more."""
    return keep_good(spark, docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every SimHash group: 3-word shingles, at most 2 differing bits."""
    return keep_first(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by marks such as ``<EMAIL>``."""
    return redact(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row in the training sequences."""
    return packing(spark, docs)


STAGES = [("language_id", language), ("quality_classifier", quality),
          ("simhash_near_dedup", near_duplicates), ("pii", personal_data),
          ("best_fit_packing", pack)]

# The classifiers cannot be stated in SQL; tests hold the run against the stages' rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written below the
    checkpoint folder, which every executor shares."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{out}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
