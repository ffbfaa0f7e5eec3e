"""Comparing file snapshots and restricting scans to changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codefindings.sources.scratch import checkpointed


def diff(base: DataFrame, head: DataFrame, keys=('repo', 'path')) -> DataFrame:
    """Paths added, deleted or changed between two snapshots. Only digests are shuffled."""
    def digest(df, name):
        return df.select(*keys, F.sha2(F.col('content').cast('binary'), 256).alias(name))
    both = digest(base, 'base_sha').join(digest(head, 'head_sha'), list(keys), 'full_outer')
    change = (F.when(F.col('base_sha').isNull(), 'added').when(F.col('head_sha').isNull(), 'deleted')
              .when(F.col('base_sha') != F.col('head_sha'), 'changed'))
    return both.withColumn('change', change).filter('change IS NOT NULL').select(*keys, 'change')


def only_changed(files: DataFrame, changed: DataFrame, key: str = 'repo') -> DataFrame:
    """Files on the changed list; a repository without any changed path is scanned in full.

    The changed paths are worked out once and checkpointed.
    """
    listed = checkpointed(changed.select(key, 'path').distinct()).withColumn('_listed', F.lit(True))
    with_diff = listed.select(key).distinct().withColumn('_has_diff', F.lit(True))
    return (files.join(listed, [key, 'path'], 'left').join(with_diff, key, 'left')
            .filter(F.col('_listed') | F.col('_has_diff').isNull()).drop('_listed', '_has_diff'))
