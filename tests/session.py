"""The local Spark session used by tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: str | int | None = None) -> SparkSession:
    cpus = cpus or os.environ.get('BENCH_CPUS', '8')
    spark = (SparkSession.builder.master(f'local[{cpus}]').appName('codefindings')
             .config('spark.sql.shuffle.partitions', str(cpus))
             .config('spark.sql.adaptive.enabled', 'true')
             .config('spark.sql.session.timeZone', 'UTC')
             .config('spark.ui.enabled', 'false')
             .config('spark.ui.showConsoleProgress', 'false')
             .config('spark.driver.memory', '8g')
             .config('spark.cleaner.referenceTracking.cleanCheckpoints', 'true')
             .config('spark.sql.files.openCostInBytes', str(1024 * 1024))
             .getOrCreate())
    spark.sparkContext.setLogLevel('ERROR')
    return spark
