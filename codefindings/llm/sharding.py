"""Sharding by extendible hashing.

A document's hash is 60 bits. A bucket is the set of documents that share a prefix of the hash; it
becomes a shard if its bytes fit the limit, else it splits on the next bit. The directory is grown
eight bits at a time: one sum per fine prefix gives the sums of all shallower prefixes, and only
documents in buckets that are still too large go on to the next round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codefindings.llm.common import doc_key, documents, leading_bits, stored, whole_text
from codefindings.llm.registry import query
from codefindings.operators.ordered import position

BITS = 60
STEP = 8
LIMIT = 8 * 1024 * 1024


def directory(rows: DataFrame, depth: int, step: int, limit: int) -> DataFrame:
    """(fine, depth, shard_bytes, shard_docs): for every ``depth + step`` bit prefix its shard.

    ``rows`` has (hash, n_bytes). The shard is the shallowest prefix of at least ``depth`` bits whose
    bytes fit ``limit`` or which holds one document; depth is NULL where none does yet.
    """
    deep = depth + step
    fine = (rows.groupBy(F.shiftright('hash', BITS - deep).alias('fine'))
            .agg(F.sum('n_bytes').alias('bytes'), F.count(F.lit(1)).alias('docs')))
    levels = fine.withColumn('depth', F.explode(F.array(*[F.lit(d) for d in range(depth, deep + 1)]))) \
        .withColumn('prefix', F.expr(f'shiftright(fine, {deep} - depth)'))
    fits = (levels.groupBy('depth', 'prefix').agg(F.sum('bytes').alias('b'), F.sum('docs').alias('n'))
            .filter((F.col('b') <= limit) | (F.col('n') == 1)))
    return (levels.join(fits, ['depth', 'prefix'], 'left').groupBy('fine')
            .agg(F.min(F.when(F.col('b').isNotNull(), F.struct('depth', 'b', 'n'))).alias('leaf'))
            .select('fine', F.col('leaf.depth').alias('depth'), F.col('leaf.b').alias('shard_bytes'),
                    F.col('leaf.n').alias('shard_docs')))


def assign(docs: DataFrame, keep: list[str] = ['doc_id'], limit: int = LIMIT) -> DataFrame:
    """``keep`` columns plus (n_bytes, depth, shard, shard_bytes, shard_docs) for every row of ``docs``.

    ``shard`` is the bit string of the prefix. A document larger than the limit ends up alone. Rows
    with the same id have the same hash and cannot be split by it: a bucket that is too large at the
    last bit is cut into numbered pages (``bits-page``) of equally many rows, each within the limit.
    An absent text has 0 bytes; a NULL id is hashed by its text. All rows, repeated ones included,
    are assigned; an empty table gives no rows.
    """
    names = {c: f'_keep_{i}' for i, c in enumerate(keep)}
    rest = stored(docs.select(*[F.col(c).alias(n) for c, n in names.items()],
                              leading_bits(doc_key(), 15).alias('hash'),
                              F.octet_length(whole_text()).cast('bigint').alias('n_bytes')), 'shard-rows')
    done, depth = [], 0
    while depth < BITS:
        step = min(STEP, BITS - depth)
        table = stored(directory(rest.select('hash', 'n_bytes'), depth, step, limit), 'shard-directory')
        marked = rest.join(table, F.shiftright('hash', BITS - depth - step) == F.col('fine'))
        bits = F.expr(f"right(lpad(conv(cast(shiftright(hash, {BITS} - depth) AS string), 10, 2), {BITS}, '0'), depth)")
        done.append(marked.filter('depth IS NOT NULL').withColumn('shard', bits)
                    .select(*names.values(), 'n_bytes', 'depth', 'shard', 'shard_bytes', 'shard_docs'))
        depth += step
        if table.filter('depth IS NULL').isEmpty():
            break
        rest = stored(marked.filter('depth IS NULL').select(*rest.columns), 'shard-rows')
    else:
        done.append(pages(rest, names, limit))
    return reduce(DataFrame.unionByName, done).withColumnsRenamed({n: c for c, n in names.items()})


def pages(rows: DataFrame, names: dict[str, str], limit: int) -> DataFrame:
    """Rows of equal hash, cut into pages of equally many rows."""
    largest = rows.groupBy('hash').agg(F.max('n_bytes').alias('_largest'))
    placed = position(rows, ['hash'], ['n_bytes'], '_place').join(largest, 'hash')
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), '_largest')))
    paged = placed.withColumn('_page', F.floor((F.col('_place') - 1) / each))
    sums = (paged.groupBy('hash', '_page')
            .agg(F.sum('n_bytes').alias('shard_bytes'), F.count(F.lit(1)).alias('shard_docs')))
    bits = F.lpad(F.conv(F.col('hash').cast('string'), 10, 2), BITS, '0')
    return (paged.join(sums, ['hash', '_page'])
            .select(*names.values(), 'n_bytes', F.lit(BITS).alias('depth'),
                    F.concat_ws('-', bits, F.col('_page').cast('string')).alias('shard'),
                    'shard_bytes', 'shard_docs'))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as one folder per shard under ``path``; no task holds more than a shard."""
    placed = assign(docs, docs.columns, limit).drop('n_bytes', 'depth', 'shard_bytes', 'shard_docs')
    placed.repartition('shard').write.partitionBy('shard').parquet(path)


SQL = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
                  ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash FROM documents),
lv AS (SELECT d.*, l.depth::INTEGER AS depth, hash >> ({BITS} - l.depth)::BIGINT AS prefix
       FROM d, range(0, {BITS} + 1) l(depth)),
b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM lv GROUP BY ALL),
r AS (SELECT lv.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY lv.depth) AS k
      FROM lv JOIN b USING (depth, prefix) WHERE shard_bytes <= {LIMIT} OR shard_docs = 1)
SELECT doc_id, n_bytes, depth, shard_bytes, shard_docs,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), {BITS}, '0'), depth) END AS shard
FROM r WHERE k = 1
"""


@query('op8_shard_documents', SQL)
def op8_shard_documents(spark, sf_dir):
    return assign(documents(spark, sf_dir))
