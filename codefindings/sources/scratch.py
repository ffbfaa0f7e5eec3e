"""Shared folders for checkpoints, streaming state and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without the setting a temporary folder is used, in local mode only.
    """
    folder = spark.conf.get('spark.checkpoint.dir', None)
    if folder:
        return folder.rstrip('/')
    if not spark.sparkContext.master.startswith('local'):
        raise ValueError('set spark.checkpoint.dir to a folder all executors can reach')
    folder = tempfile.mkdtemp(prefix='codefindings-')
    spark.conf.set('spark.checkpoint.dir', folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f'{shared_folder(spark)}/{name}-{uuid.uuid4().hex}'


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
