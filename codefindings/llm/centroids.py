"""Centroid clustering; the nearest centroid is found by the threshold algorithm.

Every dimension has the centroids sorted by their component. From a vector's own component one walks
outward in all lists at once; each step meets the next nearest centroid of every dimension, and a
centroid met for the first time has its exact distance worked out. The sum of the squared gaps at the
frontier is a lower bound for all centroids not met yet, so the walk stops when it strictly exceeds the
best exact distance (at equality an unmet centroid of smaller number could tie) or all have been met.

All arithmetic is on integers. A round is one narrow pass: tasks add up their vectors per cluster, and
only these sums are shuffled; the driver holds ``k`` centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codefindings.llm.common import stored
from codefindings.llm.negatives import embeddings, integer_vectors, matrix_of
from codefindings.llm.registry import query

BLOCK = 4096
FAR = 1 << 61
LARGEST_DISTANCE = 1 << 60
#: Fixed values of the query.
CLUSTERS, ROUNDS, SCALE, SIZE, SEED = 8, 10, 1024, 64, '3'


class Centroids:
    """``k`` integer centroids with their per-dimension sorted lists."""

    def __init__(self, rows: list[list[int]]):
        self.rows = np.array(rows, np.int64).reshape(len(rows), len(rows[0]) if rows else 0)
        self.order = np.argsort(self.rows, axis=0, kind='stable').T
        ends = np.full((self.rows.shape[1], 1), FAR)
        self.lists = np.hstack([-ends, np.take_along_axis(self.rows.T, self.order, 1), ends])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid, the smaller number on ties."""
        number, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
        for a in range(0, len(vectors), BLOCK):
            number[a:a + BLOCK], distance[a:a + BLOCK] = self._walk(vectors[a:a + BLOCK])
        return number, distance

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.rows.shape
        best, where = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        met = np.zeros((len(x), k), bool)
        left = np.column_stack([np.searchsorted(self.lists[d, 1:-1], x[:, d]) for d in range(dims)]) \
            if dims else np.zeros((len(x), 0), np.int64)
        right = left + 1
        dim, going = np.arange(dims), np.arange(len(x))
        while len(going):
            here = x[going]
            below, above = here - self.lists[dim, left], self.lists[dim, right] - here
            down = below <= above
            gap = np.where(down, below, above)
            now = np.zeros((len(going), k), bool)
            now[np.arange(len(going))[:, None], self.order[dim, np.where(down, left, right) - 1]] = True
            new = now & ~met[going] if dims else ~met[going]
            for c in range(k):
                at = np.flatnonzero(new[:, c])
                away = ((here[at] - self.rows[c]) ** 2).sum(1)
                rows = going[at]
                closer = (away < best[rows]) | ((away == best[rows]) & (c < where[rows]))
                best[rows[closer]], where[rows[closer]] = away[closer], c
            met[going] |= new
            on = ~met[going].all(1)
            on[on] = (gap[on] ** 2).sum(1) <= best[going[on]]
            left, right = (left - down)[on], (right + ~down)[on]
            going = going[on]
        return where, best

    def digest(self, c: int) -> str:
        """SHA-256 of the components as decimal integers joined by commas."""
        return hashlib.sha256(','.join(map(str, self.rows[c].tolist())).encode()).hexdigest()


def first_centroids(vectors: DataFrame, k: int, seed: str) -> Centroids:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; ties by components, NULL ids last."""
    key = F.sha2(F.concat(F.lit(f'{seed}:'), F.col('vec_id').cast('string')), 256)
    return Centroids([r.vector for r in vectors.orderBy(key.asc_nulls_last(), 'vector').limit(k).select('vector').collect()])


def cluster_sums(vectors: DataFrame, centroids: Centroids, size: int) -> DataFrame:
    """One row per cluster that has vectors: cluster, n and ``s0 …``, the sums of the components."""
    k = len(centroids.rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(pa.Table.from_batches([batch]))
                number, _ = centroids.nearest(x)
                for c in range(k):
                    mine = x[number == c]
                    n[c] += len(mine)
                    sums[c] += mine.sum(0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))],
                                         names=['cluster', 'n', 'sums'])

    parts = vectors.select('vector').mapInArrow(add, 'cluster int, n bigint, sums array<bigint>')
    return parts.groupBy('cluster').agg(F.sum('n').alias('n'), *[
        F.sum(F.col('sums')[d].cast('decimal(19,0)')).alias(f's{d}') for d in range(size)])


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = centroids.nearest(matrix_of(pa.Table.from_batches([batch])))
                yield pa.RecordBatch.from_arrays([batch.column('vec_id'), pa.array(number, pa.int32()), pa.array(distance)],
                                                 names=['vec_id', 'cluster', 'distance'])

    return vectors.mapInArrow(assign, 'vec_id bigint, cluster int, distance bigint')


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
              size: int = SIZE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    ``vectors`` has vec_id and embedding. Kept are vectors of exactly ``size`` components, none NULL and
    all finite, as floor(scale * x); a NULL id stays, and repeated rows are vectors each. ``rounds``
    times every vector goes to its nearest centroid (ties: the smaller number) and a centroid with
    vectors becomes the floor of their mean in each component; then all are assigned once more. With
    fewer than ``k`` vectors there are fewer centroids; an empty table gives no rows. Components
    so large that squared distances could exceed ``LARGEST_DISTANCE`` raise ValueError.
    """
    ints = integer_vectors(vectors.filter(F.size('embedding') == size), scale, F.col('vec_id').cast('bigint').alias('vec_id'))
    kept = stored(ints, 'vectors')
    largest = kept.agg(F.max(F.array_max(F.transform('vector', lambda x: F.abs(x.cast('double')))))).first()[0] or 0
    if size * (2 * largest) ** 2 > LARGEST_DISTANCE:
        raise ValueError(f'components of up to {largest:.3g} are too large; use a smaller scale')
    now = first_centroids(kept, k, seed)
    for _ in range(rounds if len(now.rows) else 0):
        rows = now.rows.tolist()
        for r in cluster_sums(kept, now, size).collect():
            rows[r.cluster] = [int(r[f's{d}']) // r.n for d in range(size)]
        now = Centroids(rows)
    final = stored(assigned(kept, now), 'assigned')
    per = {r.cluster: int(r.inertia) for r in final.groupBy('cluster').agg(
        F.sum(F.col('distance').cast('decimal(19,0)')).alias('inertia')).collect()}
    facts = kept.sparkSession.createDataFrame(
        [(c, x, sum(per.values()), now.digest(c)) for c, x in per.items()],
        'cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string')
    return final.join(F.broadcast(facts), 'cluster').select(
        'vec_id', 'cluster', 'distance', 'cluster_inertia', 'inertia', 'centroid_sha256')


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, seed: str = SEED) -> str:
    """The same with the rounds written one after the other; sums of squares stay exact in doubles."""
    dot = 'list_inner_product'
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
SELECT v.r, v.vec_id, v.e, c.k, {dot}(v.e, v.e) - 2 * {dot}(v.e, c.e) + {dot}(c.e, c.e) AS d FROM v CROSS JOIN c{i} c
QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.k) = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
SELECT c.k, coalesce(s.e, c.e) AS e FROM c{i} c LEFT JOIN (
  SELECT k, list(q ORDER BY j) AS e FROM (
    SELECT k, j, floor(sum(x) / count(*)) AS q FROM (SELECT k, unnest(e) AS x, unnest(range({size})) AS j FROM a{i}) GROUP BY k, j)
  GROUP BY k) s ON c.k = s.k)""")
    return f"""
WITH v AS MATERIALIZED (
SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS k, e FROM v QUALIFY k < {k}),
{', '.join(steps)}
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform((SELECT c.e FROM c{rounds} c WHERE c.k = a.k), lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a
"""


@query('op13_centroid_clustering', oracle())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(embeddings(spark, sf_dir))
