"""Order-dependent columns whose groups may be larger than one task can hold.

A plain window puts each group into one task. Here the rows are range-partitioned by group and
order first, so a hot group spreads over many slices; each slice is summed on its own and the
totals of earlier slices (one row per group and slice) are added.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from codefindings.sources.scratch import checkpointed


def running_sum(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` per ``keys`` in ``order``.

    ``order`` (column names or sort columns) should be a total order within a group. The sliced
    rows are checkpointed: both uses of the slice number must see the same partitioning, also after
    a lost executor. Give it narrow rows and join wide columns back.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get('spark.sql.shuffle.partitions'))
    sliced = checkpointed(
        df.withColumn('_value', value)
        .repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn('_slice', F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy('_slice').rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*keys, '_slice').agg(F.sum('_value').alias('_total'))
               .withColumn('_before', F.coalesce(F.sum('_total').over(earlier), F.lit(0)))
               .drop('_total'))
    inside = (Window.partitionBy('_slice', *keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    summed = sliced.withColumn('_inside', F.sum('_value').over(inside))
    # Only the first group of a slice can have rows in earlier ones: at most one offset per slice.
    carried = F.broadcast(offsets.filter('_before <> 0'))
    return (_left_join(summed, carried, [*keys, '_slice'])
            .withColumn(name, F.col('_inside') + F.coalesce('_before', F.lit(0)))
            .drop('_value', '_slice', '_inside', '_before'))


def _left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    renamed = right.withColumnsRenamed({k: f'_r_{k}' for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f'_r_{k}')) for k in keys])
    return left.join(renamed, same, 'left').drop(*[f'_r_{k}' for k in keys])


def position(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` in ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast('bigint'), name)


def previous(df: DataFrame, keys: list[str], micros: str, name: str,
             bucket: int = 3_600_000_000, tie: str | None = None) -> DataFrame:
    """Add the previous value of an integer time column per ``keys`` (NULL on the first row).

    Equal times are ordered by the column ``tie``.

    Hot keys are split into time buckets; the first row of a bucket takes the last value of the
    previous non-empty bucket, from a table with one row per key and bucket.
    """
    cut = df.withColumn('_bucket', F.expr(f'`{micros}` div {bucket}'))
    inside = Window.partitionBy(*keys, '_bucket').orderBy(micros, *([tie] if tie else []))
    by_key = Window.partitionBy(*keys).orderBy('_bucket')
    last = (cut.groupBy(*keys, '_bucket').agg(F.max(micros).alias('_last'))
            .withColumn('_carried', F.lag('_last').over(by_key)).drop('_last'))
    return (_left_join(cut.withColumn('_inside', F.lag(micros).over(inside)), last, [*keys, '_bucket'])
            .withColumn(name, F.coalesce('_inside', '_carried'))
            .drop('_inside', '_carried', '_bucket'))


def count_before(df: DataFrame, keys: list[str], micros: str, span: int, name: str) -> DataFrame:
    """Add the number of rows of the same key in the ``span`` before each row, ends excluded.

    Time is cut into buckets of ``span``; every row is also handed to the next bucket as history, so
    a key is split over as many tasks as it has buckets and each row moves twice.
    """
    own = F.expr(f'`{micros}` div {span}')
    both = df.withColumn('_copy', F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        '_bucket', own + F.col('_copy'))
    frame = Window.partitionBy(*keys, '_bucket').orderBy(micros).rangeBetween(-(span - 1), -1)
    return (both.withColumn(name, F.count(F.lit(1)).over(frame)).filter('_copy = 0')
            .drop('_copy', '_bucket'))
