"""Combining static findings with findings from other detectors."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

KEY = ['repo', 'path', 'line_number', 'vulnerability_type']


def first_per_place(found: DataFrame, key=KEY) -> DataFrame:
    """The first finding (smallest ``ord``) of each file, line and type.

    An aggregate rather than a window: it combines map-side, so a heavily repeated finding does not
    gather in one task.
    """
    rest = [c for c in found.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.col('ord')).alias('_first')
    return found.groupBy(*key).agg(first).select(*key, '_first.*').select(*found.columns)


def merge(static: DataFrame, ai: DataFrame, key=KEY) -> DataFrame:
    """All static rows, plus the first model row of each place the static rows do not cover."""
    new = first_per_place(ai, key)
    covered = static.select(*[F.col(k).alias(f'_{k}') for k in key]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f'_{k}')) for k in key])
    return static.unionByName(new.join(covered, same, 'left_anti'), allowMissingColumns=True)


def with_finding_counts(files: DataFrame, found: DataFrame, keys=('repo', 'path')) -> DataFrame:
    """Every file with its number of findings, 0 for clean files."""
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias('n_findings'))
    return files.join(counts, list(keys), 'left').na.fill(0, ['n_findings'])
