"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` smallest distinct hashes of a text's five-word shingles, in ascending order.
Sketches of parts merge into the sketch of the whole (shingles across the cut aside); two sketches
estimate resemblance, containment and the number of distinct shingles. With fewer than ``k``
shingles the sketch is the whole set and the estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codefindings.llm.common import documents, whole_text
from codefindings.llm.registry import query
from codefindings.llm.words import buffer_of, distinct, shingle_hashes, slices, word_hashes

K = 128
WIDTH = 5
PARTITION_BYTES = 32 << 20


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    shingles, bounds = shingle_hashes(*word_hashes(*buffer_of(texts)), width)
    return [smallest(shingles[a:b], k) for a, b in zip(bounds[:-1], bounds[1:])]


def smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest distinct hashes, ascending."""
    tried = 2 * k
    while tried < len(hashes):
        some = distinct(np.partition(hashes, tried - 1)[:tried])
        if len(some) >= k:
            return some[:k]
        tried *= 4
    return distinct(hashes)[:k]


def encoded(sketch: np.ndarray) -> str:
    """Big-endian 64-bit hashes in base64; an empty sketch is ''."""
    return base64.b64encode(sketch.astype('>u8').tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), '>u8').astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return distinct(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's sketch that both have: the Jaccard similarity. Two empty sketches: 1."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], 'right')) / len(union)


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below ``k``, else (k - 1) over the k-th hash's share of the range."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / ((float(sketch[-1]) + 1) / 2.0 ** 64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's distinct shingles that b has, from resemblance and counts. a empty: 1."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return min(1.0, common / distinct_count(a, k))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = pa.schema([
    ('doc_id', pa.int64()), ('n_chars', pa.int64()), ('edited_sha256', pa.string()), ('fingerprint', pa.string()),
    ('edited_fingerprint', pa.string()), ('near_edited', pa.float64()), ('near_next', pa.float64()),
    ('n_shingles', pa.float64()), ('edited_contained', pa.float64())])
DDL = ('doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, '
       'near_edited double, near_next double, n_shingles double, edited_contained double')


def compare_with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, late, doc_id, text), sorted: every row of a part but the late one with its successor."""
    held = None
    for batch in batches:
        for piece in slices(batch, 'text'):
            rows = list(zip(piece.column('part').to_pylist(), piece.column('late').to_pylist(),
                            piece.column('doc_id').to_pylist(), piece.column('text').to_pylist(),
                            sketches(piece.column('text'))))
            rows = ([held] if held else []) + rows
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:]) if a[0] == b[0] and not a[1]]
            held = rows[-1]
            if pairs:
                yield _compared(pairs)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    edited = [edited_text(a[3], b[3]) for a, b in pairs]
    made = sketches(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_arrays([
        pa.array([a[2] for a, _ in pairs], pa.int64()),
        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([encoded(a[4]) for a, _ in pairs]), pa.array([encoded(s) for s in made]),
        pa.array([resemblance(a[4], s) for (a, _), s in zip(pairs, made)], pa.float64()),
        pa.array([resemblance(a[4], b[4]) for a, b in pairs], pa.float64()),
        pa.array([distinct_count(a[4]) for a, _ in pairs], pa.float64()),
        pa.array([containment(s, a[4]) for (a, _), s in zip(pairs, made)], pa.float64())], schema=RESULT)


def fingerprint(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text and their likeness.

    Documents follow each other by (doc_id, text), NULL ids first; the last one's successor is the
    first, and a single row is its own. ``docs`` needs a bigint doc_id and text; other columns are
    left out. NULL texts are empty: fingerprint '', resemblance 1 to another empty text, else 0.
    Repeated rows follow each other. An empty table gives no rows.

    Texts are shuffled once, into ranges of doc_id. Which document opens a range is known before from
    the ids alone (one id per range on the driver), and that document is also sent to the range
    before it, so every successor is at hand and no row waits for another task.
    """
    key = F.coalesce(F.col('doc_id'), F.lit(-(1 << 63)))
    texts = docs.select('doc_id', whole_text().alias('text'), key.alias('order'))
    total = texts.agg(F.sum(F.octet_length('text'))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // partition_bytes))
    cuts = texts.agg(F.percentile_approx('order', [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf('int')
    def part_of(ids):
        return _int32(np.searchsorted(cuts, ids.to_numpy(), 'left'))

    firsts = {r.part: r.first for r in texts.select('order', part_of('order').alias('part'))
              .groupBy('part').agg(F.min('order').alias('first')).collect()}
    used = sorted(firsts)
    before = {firsts[p]: used[i - 1] for i, p in enumerate(used)}
    opening = np.array(sorted(before), np.int64)
    previous = np.array([before[i] for i in sorted(before)], np.int32)

    @F.pandas_udf('int')
    def also_in(ids):
        ids = ids.to_numpy()
        at = np.minimum(np.searchsorted(opening, ids), len(opening) - 1)
        return _int32(np.where(opening[at] == ids, previous[at], -1))

    own = F.struct(part_of('order').alias('part'), F.lit(False).alias('late'))
    copy = F.struct(also_in('order').alias('part'), F.lit(True).alias('late'))
    return (texts.withColumn('place', F.explode(F.array(own, copy))).filter('place.part >= 0')
            .select('place.part', 'place.late', 'doc_id', 'order', 'text')
            .repartitionById(max(1, len(cuts) + 1), F.col('part'))
            .sortWithinPartitions('part', 'late', 'order', 'text').drop('order')
            .mapInArrow(compare_with_next, DDL))


def _int32(values):
    import pandas as pd
    return pd.Series(values.astype(np.int32))


@query('op4_bottom_k_fingerprints')
def op4_bottom_k_fingerprints(spark, sf_dir):
    return fingerprint(documents(spark, sf_dir))
