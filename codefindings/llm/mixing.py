"""Mixing sources to target weights by repetition rates.

Words are summed per source, every source gets a target, and a document is emitted ``floor(rate)``
times plus one more copy if a draw fixed by its id falls under the fraction of the rate. The only
shuffles are the sums (one row per source and task) and the ranking of the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codefindings.llm.common import doc_key, documents, stored, unit_draw, whole_text, word_count
from codefindings.llm.registry import query
from codefindings.operators.ordered import position

SHARE = 1.5
WEIGHTS = (3, 1, 2)
CAP = 2
SEED = 'mix'


def source_targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, NULL last, weigh ``weights`` in turn and share ``share`` times all
    words. A source stops at ``cap`` times its size; the excess goes to the others by weight. That
    is one water level: a source takes ``least(cap * size, level * weight)``. The level rises until
    no further source is full; each step is one sum over the table of sources. No words: targets 0.
    """
    summed = sizes.groupBy('source').agg(F.sum('size').alias('source_size'))
    ranked = position(summed.withColumn('_all', F.lit(0)), ['_all'],
                      [F.col('source').asc_nulls_last()], '_rank')
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col('_rank') - 1, F.lit(len(weights))) + 1).cast('int'))
    table = stored(ranked.select('source', 'source_size', weight.alias('weight'),
                                 (F.col('source_size') * cap / weight).alias('full_at')), 'mix-sources')
    total = table.agg(F.sum('source_size')).first()[0] or 0
    level, last = 0.0, None
    while level != last:
        last = level
        full = F.col('full_at') < F.lit(level)
        row = table.agg(F.sum(F.when(full, F.col('source_size') * cap)).alias('spent'),
                        F.sum(F.when(~full, F.col('weight'))).alias('open')).first()
        level = (share * total - (row.spent or 0)) / row.open if row.open else level
    target = F.least((F.col('source_size') * cap).cast('double'), F.col('weight') * F.lit(float(level)))
    return table.select('source', 'source_size', target.alias('target'))


def copies(docs: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: int = CAP,
           seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are left out. A NULL text has size 0, a
    NULL source is a source of its own, repeated rows draw alike, a document with a NULL id draws by
    its text. Sizes are counted once and stored; texts are never shuffled.
    """
    sizes = stored(docs.select('doc_id', 'source', doc_key().alias('_key'),
                               word_count(whole_text()).alias('size')), 'mix-sizes')
    targets = source_targets(sizes, share, weights, cap).withColumnRenamed('source', '_source')
    rate = F.when(F.col('source_size') > 0, F.col('target') / F.col('source_size')).otherwise(0.0)
    return (sizes.join(targets, F.col('source').eqNullSafe(F.col('_source')))
            .withColumn('_rate', rate)
            .withColumn('copies', (F.floor('_rate') + F.when(
                unit_draw(seed, F.col('_key')) < F.col('_rate') - F.floor('_rate'), 1).otherwise(0)).cast('bigint'))
            .select('doc_id', 'source', 'size', 'source_size', 'target', 'copies'))


def mix(docs: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, all columns kept.

    The rate depends on the source alone and the draw on the row alone, so whole rows only meet the
    table of targets; they are not joined by id.
    """
    sizes = stored(docs.select('source', word_count(whole_text()).alias('size'))
                   .groupBy('source').agg(F.sum('size').alias('size')), 'mix-sizes')
    targets = source_targets(sizes, share, weights, cap)
    rate = F.when(F.col('source_size') > 0, F.col('target') / F.col('source_size')).otherwise(0.0)
    rates = targets.select(F.col('source').alias('_source'), rate.alias('_rate'))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias('_row'), doc_key().alias('_key'))
    whole = F.floor('_rate')
    times = whole + F.when(unit_draw(seed, F.col('_key')) < F.col('_rate') - whole, 1).otherwise(0)
    return (keyed.join(rates, F.col('_row.source').eqNullSafe(F.col('_source')))
            .withColumn('_copy', F.explode(F.array_repeat(F.lit(1), times.cast('int')))).select('_row.*'))


SQL = r"""
WITH d AS (SELECT doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, list_value(3, 1, 2)[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s0),
s AS (SELECT *, source_size * 2 / w AS full_at FROM s1),
b AS (SELECT 1.5 * sum(source_size)::DOUBLE AS budget FROM s),
f AS (SELECT a.source, (SELECT (budget - sum(CASE WHEN o.full_at < a.full_at THEN o.source_size * 2 ELSE 0 END))
                              / sum(CASE WHEN o.full_at < a.full_at THEN 0 ELSE o.w END)
                        FROM s o, b GROUP BY budget) > a.full_at AS is_full FROM s a),
l AS (SELECT (budget - sum(CASE WHEN is_full THEN source_size * 2 ELSE 0 END))
             / sum(CASE WHEN is_full THEN 0 ELSE w END) AS level
      FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source, b GROUP BY budget),
t AS (SELECT source, source_size, least(source_size * 2::DOUBLE, w * level) AS target FROM s, l),
r AS (SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query('op6_mix_sources', SQL)
def op6_mix_sources(spark, sf_dir):
    return copies(documents(spark, sf_dir)).select(
        'doc_id', 'size', 'source_size', 'target', (F.col('size') * F.col('copies')).alias('taken'))
