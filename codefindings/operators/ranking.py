"""Top-k lists, report order, request limits and latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codefindings.dims import limits, severity as dim
from codefindings.functions import risk
from codefindings.operators.ordered import count_before, position, previous


KEYS = ['repo', 'path']


def problem_files(found: DataFrame, n: int = 5) -> DataFrame:
    """Worst files by 25/15/8 points, every other severity 3 and counted as low; ties by first ``ord``."""
    named = ['CRITICAL', 'HIGH', 'MEDIUM']
    other = dim.REPORT_WEIGHTS['LOW']
    points = F.coalesce(risk.weight_of({s: dim.REPORT_WEIGHTS[s] for s in named}, F.col('severity')),
                        F.lit(other))
    per_file = found.groupBy(*KEYS).agg(
        F.sum(points).cast('bigint').alias('score'), F.count(F.lit(1)).alias('total_issues'),
        *[F.count_if(F.col('severity') == s).alias(s.lower()) for s in named],
        F.count_if(~F.coalesce(F.col('severity').isin(named), F.lit(False))).alias('low'),
        F.min('ord').alias('first_ord'))
    return per_file.filter('score > 0').orderBy(F.desc('score'), 'first_ord').limit(n)


def bar_values(files: DataFrame) -> DataFrame:
    """Add ``value``: the score, or the number of findings when the score is 0 or missing."""
    return files.withColumn('value', F.coalesce(F.nullif('score', F.lit(0)), 'n_findings'))


def top_files(files: DataFrame, n: int = 15) -> DataFrame:
    return bar_values(files).filter('value > 0').orderBy(F.desc('value'), *KEYS).limit(n)


def heatmap(files: DataFrame, n: int = 25) -> DataFrame:
    return (bar_values(files).orderBy(F.desc('value'), *KEYS).limit(n)
            .withColumn('colour', risk.heat_colour(F.col('value'))))


def _with_position(found: DataFrame, rank: Column, order: list) -> DataFrame:
    """Number the findings of each file. The rows are range-partitioned once, with all their columns."""
    return position(found.withColumn('rank', rank), KEYS, order, 'position')


def report_order(found: DataFrame) -> DataFrame:
    """Position of each finding in its file: severity rank, line, arrival (``ord``, unique per file)."""
    return _with_position(found, risk.report_rank(F.col('severity')), ['rank', 'line_number', 'ord'])


def ui_order(found: DataFrame) -> DataFrame:
    """Position by severity only, worst first; equal severities keep arrival order."""
    return _with_position(found, risk.ui_rank(F.col('severity')),
                          [F.desc_nulls_last('rank'), F.col('ord')])


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn('position', F.row_number().over(w)).filter(F.col('position') <= n)


def recent_commits(commits: DataFrame, n: int = 5) -> DataFrame:
    return latest(commits, ['repo'], [F.desc('date'), F.desc('ord')], n)


def recent_history(history: DataFrame, keys: list[str], n: int = limits.HISTORY_KEPT) -> DataFrame:
    """The last ``n`` entries per key, with the time label of the trend chart."""
    return latest(history, keys, [F.desc('ord')], n).withColumn('label', F.date_format('ts', 'HH:mm'))


def latest_status(log: DataFrame, key: str = 'analysis_id') -> DataFrame:
    """Current state per scan; the later ``event_id`` wins between equal times."""
    newest = F.max_by(F.struct('status', 'progress', 'file_count', 'ts'), F.struct('ts', 'event_id'))
    return log.groupBy(key).agg(newest.alias('s')).select(key, 's.*')


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff('MICROSECOND', F.lit('1970-01-01 00:00:00').cast('timestamp_ntz'), ts)


def request_rate(requests: DataFrame, key: str = 'key') -> DataFrame:
    """Requests of the same key in the last 60 s (exactly 60 s ago no longer counts), and the verdict."""
    timed = requests.withColumn('us', micros(F.col('ts')))
    return count_before(timed, [key], 'us', 60_000_000, 'in_last_minute').withColumn(
        'blocked', F.col('in_last_minute') >= limits.REQUESTS_PER_MINUTE)


def request_gap(requests: DataFrame, key: str = 'key') -> DataFrame:
    """Microseconds since the previous request of the key, and seconds still to wait (at least 5 apart).

    Requests at the same time follow each other by ``request_id``.
    """
    timed = requests.withColumn('us', micros(F.col('ts')))
    gap = F.col('us') - F.col('_previous')
    wait = F.greatest(F.lit(0.0), F.lit(float(limits.MIN_GAP_SECONDS)) - F.col('gap_us') / F.lit(1e6))
    return (previous(timed, [key], 'us', '_previous', tie='request_id').withColumn('gap_us', gap).drop('_previous')
            .withColumn('wait_seconds', F.when(F.col('gap_us').isNull(), 0.0).otherwise(wait)))


def daily_quota(requests: DataFrame, model_limits: DataFrame) -> DataFrame:
    """Number of each request within its model's day, and whether the quota still covers it."""
    numbered = position(requests.withColumn('day', F.to_date('ts')), ['model', 'day'],
                        ['ts', 'request_id'], 'nth')
    return numbered.join(model_limits, 'model').withColumn(
        'accepted', F.col('nth') <= F.col('daily_limit'))
