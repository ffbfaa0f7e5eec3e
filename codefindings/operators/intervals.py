"""Points and the intervals they lie in, without pairing all points and intervals of a group.

The ends of all intervals are numbered together with the points in one range-partitioned pass, so an
interval becomes a run of whole numbers. A run is cut into at most two dyadic blocks per level (blocks of
2^level numbers, as in a segment tree), a point lies in one block per level, and an equality join on
(group, level, block) yields every pair exactly once. Work is (points + intervals) x log(ends of the
largest group) plus the pairs themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from codefindings.operators.ordered import running_sum


def meet(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, interval: str,
         low: str = 'low', high: str = 'high') -> DataFrame:
    """(``keys``, ``at``, ``interval``): every distinct point with the intervals of its group it lies in.

    ``intervals`` needs ``keys``, a unique ``interval`` and the ends: ``low <= at < high``. NULL ends and
    points lie nowhere. A point in an interval is one row. Runs jobs (``running_sum`` checkpoints).
    """
    ends = intervals.filter(F.col(low).isNotNull() & F.col(high).isNotNull()).select(*keys, interval, F.explode(F.array(
        F.struct(F.col(low).alias('place'), F.lit(0).alias('last')), F.struct(F.col(high).alias('place'), F.lit(1).alias('last'))))
        .alias('e')).select(*keys, interval, 'e.*', F.lit(0).alias('point'))
    spots = points.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias('place')).distinct().withColumn('point', F.lit(1))
    rows = running_sum(ends.unionByName(spots, allowMissingColumns=True), keys, ['place', 'point', interval, 'last'],
                       F.lit(1).cast('bigint') - F.col('point'), 'rank')
    top = rows.agg(F.max('rank')).first()[0] or 0
    levels = f'sequence(0, {int(top).bit_length()})'
    # A point's rank is the number of ends at or before it: it lies in [rank of low, rank of high).
    runs = rows.filter('point = 0').groupBy(*keys, interval).agg(
        F.min(F.when(F.col('last') == 0, F.col('rank'))).alias('a'), F.min(F.when(F.col('last') == 1, F.col('rank'))).alias('b'))
    blocks = F.expr(f"""flatten(transform(transform({levels}, j -> struct(j AS level,
        shiftright(a + shiftleft(1L, j) - 1, j) AS l, shiftright(b, j) AS r)), x -> filter(array(
        IF(x.l < x.r AND x.l % 2 = 1, struct(x.level AS level, x.l AS block), NULL),
        IF(x.l < x.r AND x.r % 2 = 1, struct(x.level AS level, x.r - 1 AS block), NULL)), y -> y IS NOT NULL)))""")
    cut = runs.filter('a < b').select(*[F.col(k).alias(f'_{k}') for k in keys], interval, F.explode(blocks).alias('_n'))
    own = rows.filter('point = 1').select(*keys, F.col('place').alias(at), F.explode(F.expr(
        f'transform({levels}, j -> struct(j AS level, shiftright(rank, j) AS block))')).alias('n'))
    same = [F.col(k) == F.col(f'_{k}') for k in keys] + [F.col('n.level') == F.col('_n.level'), F.col('n.block') == F.col('_n.block')]
    return own.join(cut, reduce(and_, same)).select(*keys, at, interval)
