"""Structured Streaming jobs. Each takes streaming DataFrames and starts or describes one query."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from codefindings.dims import limits
from codefindings.dims.rules import Rule
from codefindings.operators import scan
from codefindings.operators.merge import first_per_place
from codefindings.plans.report import alerts

LATENESS = '10 minutes'


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str,
                  mode: str = 'append') -> None:
    """Process everything available now, into a parquet folder or a batch function, and stop."""
    writer = (df.writeStream.outputMode(mode).trigger(availableNow=True)
              .option('checkpointLocation', checkpoint))
    query: StreamingQuery = (writer.foreachBatch(sink).start() if callable(sink)
                             else writer.format('parquet').start(sink))
    query.awaitTermination()


def scan_new_files(files: DataFrame, rules: Iterable[Rule] | None = None,
                   keep: Iterable[str] = ('path',)) -> DataFrame:
    """Findings of arriving files: the batch scan is a projection, so it runs on a stream as it is."""
    return scan.findings(files, rules, keep)


def severity_trend(found: DataFrame, width: str = '1 day', ts: str = 'ts') -> DataFrame:
    """Findings per severity and tumbling window.

    In append mode a window comes out once it can no longer change; in update mode, with
    :func:`append_versions` and ``newest_versions`` by (start, severity), open windows are there too.
    """
    return (found.withWatermark(ts, LATENESS)
            .groupBy(F.window(ts, width).alias('w'), 'severity').agg(F.count(F.lit(1)).alias('n'))
            .select(F.col('w.start').alias('start'), F.col('w.end').alias('end'), 'severity', 'n'))


def request_windows(requests: DataFrame, key: str = 'key', ts: str = 'ts') -> DataFrame:
    """Requests per key in sliding 60 s windows, every 10 s, with a flag for too many.

    As with :func:`severity_trend`, update mode also shows the windows that are still open.
    """
    counted = (requests.withWatermark(ts, LATENESS)
               .groupBy(key, F.window(ts, '60 seconds', '10 seconds').alias('w'))
               .agg(F.count(F.lit(1)).alias('n')))
    return counted.select(key, F.col('w.start').alias('start'), F.col('w.end').alias('end'), 'n',
                          (F.col('n') >= limits.REQUESTS_PER_MINUTE).alias('breach'))


def drop_repeats(found: DataFrame, key: Iterable[str], ts: str = 'ts') -> DataFrame:
    """Drop findings repeated within the lateness bound; state is kept for that long only.

    A finding that comes back later is passed on again: :func:`first_sightings` keeps those out too.
    """
    return found.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark(list(key))


def first_sightings(path: str, key: Iterable[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch function that writes each key once, however many batches apart it comes again.

    Rows lie in folders by a hash of the key; a batch reads the folders of its own keys only. A
    repeated batch ignores and replaces its own earlier rows.
    """
    key = list(key)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key).withColumn('bucket', F.pmod(F.xxhash64(*key), F.lit(buckets)))
        if batch_id > 0:
            met = [r.bucket for r in new.select('bucket').distinct().collect()]
            written = new.withColumn('batch', F.lit(batch_id).cast('bigint')).schema
            seen = (spark.read.schema(written).option('basePath', path).parquet(path)
                    .filter(F.col('bucket').isin(met) & (F.col('batch') < batch_id))
                    .select(*[F.col(k).alias(f'_{k}') for k in key]))
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f'_{k}')) for k in key])
            new = new.join(seen, same, 'left_anti')
        new.withColumn('batch', F.lit(batch_id).cast('bigint')).write.mode('overwrite').option(
            'partitionOverwriteMode', 'dynamic').partitionBy('batch', 'bucket').parquet(path)
    return write


def latest_state(log: DataFrame, key: str, columns: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Newest row per key, for update mode with :func:`append_versions`."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return log.groupBy(key).agg(newest.alias('s')).select(key, 's.*')


def append_versions(path: str) -> Callable[[DataFrame, int], None]:
    """Batch function keeping every batch in its own folder; a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode('overwrite').parquet(f'{path}/batch={batch_id}')
    return write


def newest_versions(spark: SparkSession, path: str, key: Iterable[str]) -> DataFrame:
    """Read back what :func:`append_versions` wrote: per key the row of the latest batch."""
    rows = spark.read.option('basePath', path).parquet(path)
    rest = [c for c in rows.columns if c not in (*key, 'batch')]
    newest = F.max_by(F.struct(*rest), F.col('batch')).alias('s')
    return rows.groupBy(*key).agg(newest).select(*key, 's.*')


def alert_sink(path: str, seen_key: str = 'scan_id') -> Callable[[DataFrame, int], None]:
    """Batch function writing one alert per scan, also across batches: the first one, by ``ord``."""
    write = first_sightings(path, [seen_key])
    return lambda batch, batch_id: write(first_per_place(alerts(batch), [seen_key]), batch_id)


def as_instant(ts: str = 'ts') -> Column:
    """Watermarks need an instant; zone-less times are read in the session's zone."""
    return F.col(ts).cast('timestamp')
