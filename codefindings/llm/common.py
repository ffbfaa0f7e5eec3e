"""What the operators share: input tables, word counting, reproducible hashing, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codefindings.sources.scratch import new_folder

WORD = r'[^\x20\x09-\x0D]+'
#: While a table is written: shuffle files go when the write ends, and Arrow batches are small.
WRITING = {'spark.sql.classic.shuffleDependency.fileCleanup.enabled': 'true',
           'spark.sql.execution.arrow.maxRecordsPerBatch': '1000'}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f'{sf_dir}/documents.parquet')


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f'{sf_dir}/labels.parquet')


def whole_text() -> Column:
    """The text; an absent one counts as empty."""
    return F.coalesce(F.col('text'), F.lit(''))


def doc_id() -> Column:
    """The id as a bigint, whatever integer type it has."""
    return F.col('doc_id').cast('bigint').alias('doc_id')


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast('bigint')


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders ``by`` columns, and read it back.

    Later steps read the files, so a lost executor costs a re-read, not the work above. Shuffle files
    of the write are removed once it has ended. The folder is under ``spark.checkpoint.dir``; what
    lies there may be deleted once the job has ended.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.partitionBy(*by).option('compression', 'zstd').parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small Arrow batches from now on: whole texts may be long, memory is shared."""
    spark.conf.set('spark.sql.execution.arrow.maxRecordsPerBatch', '1000')


def doc_key() -> Column:
    """A string that names the document: its id, or a digest of its text where the id is NULL."""
    return F.coalesce(F.col('doc_id').cast('string'), F.concat(F.lit('text:'), F.md5(whole_text())))


def leading_bits(key: Column, digits: int) -> Column:
    """The first ``4 * digits`` bits of the MD5 of a string, as a non-negative bigint (digits <= 15)."""
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast('bigint')


def unit_draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key (52 bits of an MD5)."""
    return leading_bits(F.concat(F.lit(f'{seed}:'), key), 13) / F.lit(float(1 << 52))


#: A key is heavy if it has more than one in so many of the rows; so there are at most so many of them.
HEAVY = 1000


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, own_key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and the number of ``rows`` it meets.

    Keys with more than one in ``HEAVY`` of the rows, at most ``HEAVY`` of them, are met by broadcast, so
    their rows stay where they are; all others by a join of Spark's choice. NULL keys meet nothing.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    heavy = keyed.filter(F.col(count) * HEAVY > total)
    light = keyed.filter(F.col(count) * HEAVY <= total)
    usual = rows.join(F.broadcast(heavy.select(own_key)), F.col(key) == F.col(own_key), 'left_anti')
    return (rows.join(F.broadcast(heavy), F.col(key) == F.col(own_key))
            .unionByName(usual.join(light, F.col(key) == F.col(own_key))).drop(own_key))
