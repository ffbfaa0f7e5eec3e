"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a vector of transformed counts (log shares of character kinds, repetition, word
shape). Both classes get a mean and a covariance shrunk towards the pooled one; a document's score
is the logistic of the difference of the two log densities per feature, computed with cached
Cholesky factors. Only class sums (a count, a vector and a matrix each) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codefindings.llm.common import doc_id, documents, labels, stored, whole_text
from codefindings.llm.registry import query
from codefindings.llm.words import SPACE, buffer_of, distinct, shingle_hashes, slices, word_hashes

FOLDS = 5
CUT = 0.3
SHRINKAGE = 0.1
RIDGE = 1e-2


def _kind(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = _kind('0123456789')
KINDS = [UPPER, DIGIT, _kind('#*$%&|<>'), _kind('!'), _kind('.,;:?'), _kind('\n'), _kind('=_/\\{}[]"@~^+')]
CONTINUED = np.zeros(256, bool)
CONTINUED[128:192] = True
FEATURES = 7 + len(KINDS)


def features(texts: pa.Array) -> np.ndarray:
    """(documents, FEATURES) numbers; finite for empty texts too."""
    data, offsets = buffer_of(texts)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), offsets)).astype(float)

    chars = np.diff(offsets) - per_doc(CONTINUED[data])
    hashes, bounds = word_hashes(data, offsets)
    words = np.diff(bounds).astype(float)
    inner = chars - per_doc(SPACE[data])
    shingles, edges = shingle_hashes(hashes, bounds, 3)
    unique = np.array([len(distinct(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])])
    windows = np.diff(edges).astype(float)
    fresh = np.array([len(distinct(shingles[a:b])) for a, b in zip(edges[:-1], edges[1:])])
    same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    same = np.setdiff1d(same, bounds, assume_unique=False)
    echoes = np.diff(np.searchsorted(same, bounds)).astype(float)
    share = lambda a, b: np.log((a + 0.5) / (b + 1.0))
    columns = [np.log1p(words), share(inner, words), share(words - unique, words), share(windows - fresh, windows),
               share(echoes, words), share(unique, np.sqrt(words)), share(per_doc(data > 127), inner)]
    columns += [share(per_doc(kind[data]), inner) for kind in KINDS]
    return np.stack(columns, 1)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes, and the prior odds."""
    means: np.ndarray
    factors: np.ndarray
    dets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The logistic of the mean log-density difference per feature, class 1 against class 0."""
        density = []
        for mean, factor, det in zip(self.means, self.factors, self.dets):
            z = (x - mean) @ factor.T
            density.append(-0.5 * (z * z).sum(1) - 0.5 * det)
        gap = (density[1] - density[0]) / x.shape[1]
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -30.0, 30.0)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE,
                 ridge: float = RIDGE) -> Discriminant | None:
    """The model from (count, sum, sum of outer products) per class; None unless both classes occur.

    A class with n rows keeps ``(1 - shrinkage) * n / (n + d)`` of its own covariance, the rest is
    the pooled one; ``ridge`` of the pooled variances is added to the diagonal.
    """
    if any(sums.get(k, (0,))[0] < 2 for k in (0, 1)):
        return None
    means = {k: s / n for k, (n, s, _) in sums.items()}
    own = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in sums.items()}
    total = sum(n for n, _, _ in sums.values())
    pooled = sum(own[k] * sums[k][0] for k in own) / total
    d = len(pooled)
    floor = ridge * np.diag(np.maximum(np.diag(pooled), 1e-4))
    factors, dets = [], []
    for k in (0, 1):
        n = sums[k][0]
        keep = (1 - shrinkage) * n / (n + d)
        lower = np.linalg.cholesky(keep * own[k] + (1 - keep) * pooled + floor)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(np.array([means[0], means[1]]), np.array(factors), np.array(dets))


def held_out(doc_id, folds: int = FOLDS):
    """Rows that no model learns from: crc32 of the id as text divisible by ``folds`` (NULL: of '')."""
    return F.crc32(F.coalesce(doc_id.cast('string'), F.lit(''))) % folds == 0


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the features of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 'text'):
                x = features(piece.column('text'))
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([piece.column('doc_id'), lists], names=['doc_id', 'x'])

    return docs.select(doc_id(), whole_text().alias('text')).mapInArrow(run, 'doc_id bigint, x array<double>')


def fit(table: DataFrame, quality: DataFrame, folds: int = FOLDS) -> Discriminant | None:
    """Learn from the rows of ``table`` (doc_id, x) with a label 0 or 1 that are not held out."""
    learn = (quality.filter(~held_out(F.col('doc_id'), folds)).filter('quality IN (0, 1)')
             .select(F.col('doc_id').alias('_doc'), 'quality'))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + FEATURES + FEATURES * FEATURES) for k in (0, 1)}
        for batch in batches:
            x = batch.column('x').flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            y = batch.column('quality').to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k in (0, 1):
            if total[k][0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(total[k]), pa.int32()), pa.array(np.arange(len(total[k])), pa.int32()),
                     pa.array(total[k])], names=['quality', 'i', 'value'])

    rows = (table.join(learn, F.col('doc_id') == F.col('_doc')).select('x', F.col('quality').cast('int').alias('quality'))
            .mapInArrow(sums, 'quality int, i int, value double')
            .groupBy('quality', 'i').agg(F.sum('value').alias('value')).collect())
    flat = {k: np.zeros(1 + FEATURES + FEATURES * FEATURES) for k in (0, 1)}
    for r in rows:
        flat[r.quality][r.i] = r.value
    return discriminant({k: (v[0], v[1:1 + FEATURES], v[1 + FEATURES:].reshape(FEATURES, FEATURES)) for k, v in flat.items()})


def scored(docs: DataFrame, quality: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    ``docs`` needs doc_id and text, ``quality`` doc_id and quality; other columns are left out. NULL
    texts are empty and scored like any other. NULL ids have no label. Repeated rows count as often
    as they occur. Without labels of both classes every score is 1: nothing is rejected unlearned.
    """
    table = stored(measured(docs), 'quality-features')
    model = fit(table, quality)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column('x').flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            score = model.score(x) if model else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column('doc_id'), pa.array(score)], names=['doc_id', 'score'])

    return table.mapInArrow(run, 'doc_id bigint, score double').select(
        'doc_id', held_out(F.col('doc_id')).alias('held_out'), 'score',
        F.when(F.col('score') >= cut, 1).otherwise(0).alias('predicted'))


def accepted(docs: DataFrame, quality: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, all columns kept. Texts never leave their task."""
    model = fit(stored(measured(docs), 'quality-features'), quality)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 'text'):
                if model:
                    piece = piece.filter(pa.array(model.score(features(piece.column('text'))) >= cut))
                yield piece

    return docs.mapInArrow(run, docs.schema)


@query('op3_quality_discriminant')
def op3_quality_discriminant(spark, sf_dir):
    return scored(documents(spark, sf_dir), labels(spark, sf_dir))
