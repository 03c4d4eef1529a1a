"""The corpus pipeline: each stage is one operator of tidemark.llm over what the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, fingerprint_dedup, minhash_forest, temperature_mixing, toxicity
from tidemark.llm.common import cut, last_path, release, table

#: Rows that a Python worker of the pipeline holds at once; with Arrow's default of 10,000 whole
#: texts, executors that keep their workers from stage to stage come near their memory's end.
ARROW_ROWS = "2000"


ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Spark reads the setting when a stage runs, after its function has returned, so a stage
    leaves it set; run() puts it back."""
    spark.conf.set(ARROW_SETTING, ARROW_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return fingerprint_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return minhash_forest.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return temperature_mixing.mixed(docs, docs.columns, added=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained network has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages write on their way is deleted as soon as the next one has written."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(ARROW_SETTING)
    try:
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), name)
            release(spark, but=(last_path(),))
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(ARROW_SETTING, before)
