"""Hard negatives by exact integer scores, multiplied in a residue number system.

The scores of a set of anchors against all rows are products of two integer matrices. Both are cut into
tiles, and one Spark group multiplies one tile of anchors with one tile of rows:

1. The tile's components modulo several small primes go through float32 products. ``INNER`` columns at
   a time keep every sum below 2^24, so float32 holds it exactly.
2. The exact signed score is put together from its residues by Chinese remaindering in balanced mixed
   radix digits. There are as many primes as the largest norm in the table asks for.
3. The best rows of a tile go on; the best of all tiles are found by a window with a group limit.

Two passes: the first finds every anchor's positives, the second, which knows their scores, the
negatives inside each positive's score window. Scores are never stored; a label's size plays no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codefindings.llm.common import stored
from codefindings.llm.registry import query

INNER = 64
LARGEST_PRIME = 1021
TILE_ROWS = 4096
TILE_VALUES = 1 << 20
STRIP = 256
LARGEST_SCORE = 1 << 55

SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k
      FROM s WHERE same AND vec_id <> anchor_id QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


def primes_for(bound: int) -> list[int]:
    """The largest primes up to ``LARGEST_PRIME`` whose product exceeds ``2 * bound + 1``."""
    found, product, n = [], 1, LARGEST_PRIME
    while product <= 2 * bound + 1:
        if all(n % q for q in range(3, int(n ** 0.5) + 1, 2)):
            found.append(n)
            product *= n
        n -= 2
    return found


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between ``-p / 2`` and ``p / 2``."""
    r = x % p
    return r - p * (r > p // 2)


class Tile:
    """A matrix of 64-bit integers as float32 residues, one matrix per prime."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [centred(matrix, p).astype(np.float32) for p in primes]

    def scores(self, other: Tile, a: int, b: int) -> np.ndarray:
        """The exact products of rows ``a`` to ``b`` with all rows of ``other``, |score| <= ``LARGEST_SCORE``."""
        value, product = None, 1
        for p, mine, theirs in zip(self.primes, self.parts, other.parts):
            residue = np.zeros((b - a, len(theirs)), np.int64)
            for k in range(0, mine.shape[1], INNER):
                residue += (mine[a:b, k:k + INNER] @ theirs[:, k:k + INNER].T).astype(np.int64)
            if value is None:
                value = centred(residue, p)
            else:
                value += centred((residue - value) * pow(product, -1, p), p) * product
            product *= p
        return value


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores in falling order; of equal ones, the first."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind='stable')][:k]


def matrix_of(table: pa.Table) -> np.ndarray:
    held = table.column('vector').combine_chunks()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    return held.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def positives_of(n: int, primes: list[int]):
    """A function of (tile of anchors, tile of rows): the ``n`` best other rows of each anchor's label."""
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by([('label', 'ascending'), ('vec_id', 'ascending')])
            label, vec_id = rows.column('label').to_numpy(), rows.column('vec_id').to_numpy()
            mine, all_rows = Tile(matrix_of(anchors), primes), Tile(matrix_of(rows), primes)
            slots, names, kinds = (anchors.column(c).to_pylist() for c in ('slot', 'vec_id', 'label'))
            for a in range(0, len(slots), STRIP):
                for i, scores in enumerate(mine.scores(all_rows, a, min(a + STRIP, len(slots))), a):
                    low, high = np.searchsorted(label, kinds[i]), np.searchsorted(label, kinds[i], 'right')
                    other = low + np.flatnonzero(vec_id[low:high] != names[i])
                    at = other[best(scores[other], n)]
                    out += [(slots[i], *x) for x in zip(vec_id[at].tolist(), scores[at].tolist())]
        return as_table(out, ['slot', 'positive_id', 'positive_score'])
    return find


def negatives_of(n: int, low: int, high: int, primes: list[int]):
    """A function of (tile of anchors with positives, tile of rows): the ``n`` best rows in each score window."""
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by('vec_id')
            label, vec_id = rows.column('label').to_numpy(), rows.column('vec_id').to_numpy()
            mine, all_rows = Tile(matrix_of(anchors), primes), Tile(matrix_of(rows), primes)
            slots, kinds, given = (anchors.column(c).to_pylist() for c in ('slot', 'label', 'positives'))
            for a in range(0, len(slots), STRIP):
                for i, scores in enumerate(mine.scores(all_rows, a, min(a + STRIP, len(slots))), a):
                    spans = [(-(-low * p['positive_score'] // 100), high * p['positive_score'] // 100) for p in given[i]]
                    at = np.flatnonzero((label != kinds[i]) & (scores >= min(s[0] for s in spans))
                                        & (scores <= max(s[1] for s in spans)))
                    at = at[np.argsort(-scores[at], kind='stable')]
                    falling = -scores[at]
                    for (least, most), p in zip(spans, given[i]):
                        start, end = np.searchsorted(falling, -most), np.searchsorted(falling, -least, 'right')
                        some = at[start:min(end, start + n)] if start < end else at[:0]
                        out += [(slots[i], p['k'], *x) for x in zip(vec_id[some].tolist(), scores[some].tolist())]
        return as_table(out, ['slot', 'k', 'negative_id', 'negative_score'])
    return find


def as_table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def integer_vectors(vectors: DataFrame, scale: int, *keep: Column) -> DataFrame:
    """``keep`` and ``vector``, the components as floor(scale * x); rows with a NULL or non-finite component go."""
    real = F.forall('embedding', lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float('inf')))
    return (vectors.filter(F.col('embedding').isNotNull()).filter(F.coalesce(real, F.lit(False)))
            .select(*keep, F.transform('embedding', lambda x: F.floor(x.cast('double') * F.lit(float(scale)))).alias('vector')))


def norm(vector: str) -> Column:
    """The sum of squares, as a double."""
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast('double') * x.cast('double'))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, embedding and label; rows with a NULL in one of them or in a component, or
    with a component that is not finite, take no part. ``anchor`` says of a row whether it is one.
    Scores are inner products of floor(scale * x); higher ones come first, ties by smaller vec_id. An
    anchor's positives are its best rows of the same label with another vec_id; a positive's negatives
    are the best rows of other labels with ``low / 100 <= score / positive score <= high / 100``, written
    without division. Fewer are returned where there are fewer. Repeated rows are rows: as an anchor
    each has its own result. Shorter vectors count as filled up with 0. An empty table, and a table without
    anchors, gives no rows. Scores beyond ``LARGEST_SCORE`` raise ValueError.
    """
    found = integer_vectors(vectors.filter('vec_id IS NOT NULL AND label IS NOT NULL'), scale,
                            F.col('vec_id').cast('bigint').alias('vec_id'), F.col('label').cast('bigint').alias('label'),
                            F.coalesce(anchor, F.lit(False)).alias('anchor'))
    rows = stored(found.withColumn('slot', F.monotonically_increasing_id()), 'vectors')
    n, n_anchors, size, largest = rows.agg(
        F.count(F.lit(1)), F.count_if('anchor'), F.max(F.size('vector')), F.max(norm('vector'))).first()
    size, largest = size or 0, largest or 0.0
    if largest * 1.01 > LARGEST_SCORE:
        raise ValueError(f'scores of up to {largest:.3g} do not fit; use a smaller scale')
    primes = primes_for(int(largest * 1.01) + 1)
    width = max(1, size)
    rows = rows.withColumn('vector', F.concat('vector', F.array_repeat(F.lit(0).cast('bigint'), F.lit(width) - F.size('vector'))))
    per_tile = max(1, min(tile_rows, TILE_VALUES // width))
    n_tiles, n_blocks = max(1, -(-n // per_tile)), max(1, -(-n_anchors // per_tile))
    dealt = lambda count: F.pmod(F.xxhash64('slot'), F.lit(count)).cast('int')
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    anchors = stored(rows.filter('anchor').select('slot', 'vec_id', 'label', 'vector', dealt(n_blocks).alias('block')), 'anchors')
    grid = rows.select('vec_id', 'label', 'vector', dealt(n_tiles).alias('tile'), every(n_blocks).alias('block'))

    def multiplied(left: DataFrame, find, schema: str) -> DataFrame:
        tiles = left.withColumn('tile', every(n_tiles))
        return tiles.groupBy('block', 'tile').cogroup(grid.groupBy('block', 'tile')).applyInArrow(find, schema)

    def leading(df: DataFrame, key: list[str], score: str, name: str, count: int, rank: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc(score), name)
        return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= count)

    pairs = stored(leading(
        multiplied(anchors, positives_of(positives, primes), 'slot bigint, positive_id bigint, positive_score bigint'),
        ['slot'], 'positive_score', 'positive_id', positives, 'k'), 'positives')
    chosen = pairs.groupBy(F.col('slot').alias('_slot')).agg(
        F.sort_array(F.collect_list(F.struct(F.col('k').cast('bigint').alias('k'), 'positive_score'))).alias('positives'))
    known = anchors.join(chosen, F.col('slot') == F.col('_slot')).select('slot', 'label', 'vector', 'block', 'positives')
    hard = leading(
        multiplied(known, negatives_of(negatives, low, high, primes), 'slot bigint, k bigint, negative_id bigint, negative_score bigint'),
        ['slot', 'k'], 'negative_score', 'negative_id', negatives, 'rank')
    named = pairs.join(anchors.select(F.col('slot').alias('_slot'), F.col('vec_id').alias('anchor_id')),
                       F.col('slot') == F.col('_slot')).drop('_slot')
    return (hard.join(named, ['slot', 'k'])
            .select('anchor_id', 'positive_id', 'rank', 'negative_id', 'positive_score', 'negative_score'))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f'{sf_dir}/embeddings.parquet')


@query('op12_hard_negatives', SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col('vec_id') % 7 == 0, (F.col('label') + 1) % 10).otherwise(F.col('label'))
    return hard_negatives(embeddings(spark, sf_dir).withColumn('label', moved), F.col('vec_id') % 100 == 0)
