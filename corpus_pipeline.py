"""The corpus pipeline: documents go through the stages in turn, each written before the next reads it.

Quality classifier, near-duplicate removal, personal data, mixing of sources, packing. All stages but
the last return the columns of ``documents``; the last one returns the packed pieces. Labels are read
from ``sf_dir``. SQL cannot express the stages, so each is tested against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codefindings.llm import mixing, neardup, packing, pii, quality
from codefindings.llm.common import documents, labels, small_batches, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the classifier accepts (score 0.3 or more)."""
    small_batches(spark)
    return quality.accepted(docs, labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group linked by a similarity of 0.8 or more over five-word shingles."""
    return neardup.one_of_each(docs, neardup.Likeness())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind."""
    small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that the sources meet their target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ('quality', keep_quality), ('near duplicates', drop_near_duplicates), ('personal data', redact_personal_data),
    ('mixing', mix_sources), ('packing', pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(' ', '-'))
    return STAGES[-1][1](spark, docs, sf_dir)
