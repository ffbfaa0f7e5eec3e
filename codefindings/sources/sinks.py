"""Sinks: JSON export, history table, alert table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codefindings.operators.ranking import recent_history
from codefindings.plans.report import alerts


def export_json(results: DataFrame, path: str) -> None:
    """Write results as JSON lines, one file per partition; absent values are left out."""
    results.write.mode('overwrite').json(path)


def append_history(summaries: DataFrame, path: str) -> None:
    """Append one row per finished scan."""
    summaries.write.mode('append').parquet(path)


def read_history(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last 20 entries per key."""
    return recent_history(spark.read.parquet(path), keys)


def append_alerts(summaries: DataFrame, path: str, batch: str | int) -> None:
    """Write the alert rows of one batch under its own folder, so a repeated batch replaces itself."""
    (alerts(summaries).withColumn('batch', F.lit(str(batch)))
     .write.mode('overwrite').parquet(f'{path}/batch={batch}'))
