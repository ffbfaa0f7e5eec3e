"""Streams fed in two micro-batches give what the batch operators give."""

from pyspark.sql import functions as F

from codefindings import catalog
from codefindings.operators import ranking, scan
from codefindings.streaming import jobs


def feed(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode('append').parquet(f'{folder}/{name}')


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option('recursiveFileLookup', True).option('maxFilesPerTrigger', 1).parquet(folder)


def test_scan_stream_equals_batch(spark, tmp_path):
    schema = 'path string, language string, content string'
    rows = [('a', 'python', 'eval(x)\n../'), ('b', 'go', 'md5(x)'), ('c', 'php', 'exec($a); exec($b)')]
    feed(spark, tmp_path / 'in', rows[:2], schema, '1')
    files = source(spark, str(tmp_path / 'in'), schema)
    for more in (rows[2:], []):
        jobs.run_available(jobs.scan_new_files(files), str(tmp_path / 'out'), str(tmp_path / 'state'))
        if more:
            feed(spark, tmp_path / 'in', more, schema, '2')
    batch = scan.findings(spark.createDataFrame(rows, schema))
    columns = ['path', 'rule_id', 'line_number', 'code_snippet', 'occurrence']
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / 'out')).select(*columns).collect()))
    assert got == sorted(map(tuple, batch.select(*columns).collect())) and got


def test_trend_drops_late_rows(spark, tmp_path):
    schema = 'ts timestamp, severity string'
    def at(text):
        return F.lit(text).cast('timestamp')
    first = spark.range(3).select(at('2024-01-03 12:00:00').alias('ts'), F.lit('HIGH').alias('severity'))
    first = first.union(spark.range(2).select(at('2024-01-01 01:00:00'), F.lit('HIGH')))
    first.coalesce(1).write.parquet(f'{tmp_path}/in/1')
    files = source(spark, str(tmp_path / 'in'), schema)
    run = lambda: jobs.run_available(jobs.severity_trend(files), str(tmp_path / 'out'), str(tmp_path / 'state'))
    run()
    late = spark.range(5).select(at('2024-01-01 02:00:00').alias('ts'), F.lit('HIGH').alias('severity'))
    late.union(spark.range(1).select(at('2024-01-05 00:30:00'), F.lit('LOW'))).coalesce(1).write.parquet(f'{tmp_path}/in/2')
    run()
    got = sorted((str(r.start.date()), r.severity, r.n) for r in spark.read.parquet(str(tmp_path / 'out')).collect())
    assert got == [('2024-01-01', 'HIGH', 2), ('2024-01-03', 'HIGH', 3)]


def test_repeats_across_batches(spark, tmp_path):
    schema = 'ts timestamp, path string'
    for i in range(2):
        spark.range(3).select(F.lit('2024-01-01 00:00:00').cast('timestamp').alias('ts'), F.lit('a').alias('path')) \
            .coalesce(1).write.parquet(f'{tmp_path}/in/{i}')
    jobs.run_available(jobs.drop_repeats(source(spark, str(tmp_path / 'in'), schema), ['path']), str(tmp_path / 'out'), str(tmp_path / 'state'))
    assert spark.read.parquet(str(tmp_path / 'out')).count() == 1


def test_latest_state_and_alerts_across_batches(spark, tmp_path):
    schema = 'scan_id int, ord int, repo string, critical int, high int, status string'
    feed(spark, tmp_path / 'in', [(1, 1, 'r', 1, 0, 'processing'), (1, 2, 'r', 2, 0, 'processing'), (2, 3, 's', 0, 0, 'processing')], schema, '1')
    files = source(spark, str(tmp_path / 'in'), schema)

    def run():
        jobs.run_available(jobs.latest_state(files, 'scan_id', ['status', 'ord'], ['ord']), jobs.append_versions(str(tmp_path / 'latest')),
                           str(tmp_path / 's1'), 'update')
        jobs.run_available(files, jobs.alert_sink(str(tmp_path / 'alerts')), str(tmp_path / 's2'))
    run()
    feed(spark, tmp_path / 'in', [(1, 4, 'r', 3, 0, 'completed'), (3, 5, 't', 0, 1, 'failed')], schema, '2')
    run()
    latest = {r.scan_id: r.status for r in jobs.newest_versions(spark, str(tmp_path / 'latest'), ['scan_id']).collect()}
    assert latest == {1: 'completed', 2: 'processing', 3: 'failed'}
    alerts = spark.read.parquet(str(tmp_path / 'alerts')).select('scan_id', 'ord').collect()
    assert sorted(map(tuple, alerts)) == [(1, 1), (3, 5)]


def test_sliding_rate_covers_batch_count(spark, tmp_path):
    rows = spark.range(40).select(F.lit('k').alias('key'), F.timestamp_seconds(F.col('id') * 3 + 1_700_000_000).alias('ts'))
    end = spark.range(1).select(F.lit('k'), F.timestamp_seconds(F.lit(1_700_010_000)))
    rows.union(end).coalesce(1).write.parquet(f'{tmp_path}/in/1')
    out = jobs.request_windows(source(spark, str(tmp_path / 'in'), 'key string, ts timestamp'))
    jobs.run_available(out, str(tmp_path / 'out'), str(tmp_path / 'state'))
    got = spark.read.parquet(str(tmp_path / 'out'))
    assert got.agg(F.max('n')).collect()[0][0] == 20 and got.filter('breach').count() > 0
    exact = ranking.request_rate(rows.withColumn('ts', F.col('ts').cast('timestamp_ntz')))
    assert exact.agg(F.max('in_last_minute')).collect()[0][0] == 19


def test_first_sightings_over_many_batches(spark, tmp_path):
    for i in range(6):
        spark.range(3).select(F.timestamp_seconds(F.lit(1_700_000_000 + 7200 * i)).alias('ts'), F.concat(F.lit('p'), F.col('id') * (i % 2)).alias('path')) \
            .coalesce(1).write.parquet(f'{tmp_path}/in/{i}')
    rows = source(spark, str(tmp_path / 'in'), 'ts timestamp, path string')
    jobs.run_available(rows, jobs.first_sightings(str(tmp_path / 'out'), ['path']), str(tmp_path / 'state'))
    got = [r.path for r in spark.read.parquet(str(tmp_path / 'out')).select('path').collect()]
    assert sorted(got) == ['p0', 'p1', 'p2']


def test_open_windows_are_read_back(spark, tmp_path):
    for i in range(6):
        spark.range(2).select(F.timestamp_seconds(F.lit(1_700_000_000 + 40_000 * i)).alias('ts'), F.lit('HIGH').alias('severity')) \
            .coalesce(1).write.parquet(f'{tmp_path}/in/{i}')
    trend = jobs.severity_trend(source(spark, str(tmp_path / 'in'), 'ts timestamp, severity string'))
    jobs.run_available(trend, jobs.append_versions(str(tmp_path / 'out')), str(tmp_path / 'state'), 'update')
    assert sum(r.n for r in jobs.newest_versions(spark, str(tmp_path / 'out'), ['start', 'severity']).collect()) == 12


def test_table_in_part_files_is_streamed_whole(spark, sf, tmp_path):
    for name in ('documents', 'events'):
        spark.read.parquet(f'{sf}/{name}.parquet').repartition(3).write.parquet(f'{tmp_path}/{name}.parquet')
    for query in ('stream_scan', 'stream_latest_status'):
        run = catalog.queries()[query]
        got, want = (sorted(map(str, run(spark, folder).collect())) for folder in (str(tmp_path), sf))
        assert got == want and got
