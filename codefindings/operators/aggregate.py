"""Roll-ups of findings: counts, shares, scores and summaries.

Every aggregate combines map-side first, so a file, type or repository holding a third of all
findings costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codefindings.dims import severity as dim
from codefindings.functions import risk
from codefindings.sources.scratch import checkpointed

FEW_GROUPS = 10_000
COUNTS = [s.lower() for s in dim.SEVERITIES]


def _weight(found: DataFrame) -> Column | None:
    """Findings in compact form carry their number of matches."""
    return F.col('n_matches') if 'n_matches' in found.columns else None


def by_severity(found: DataFrame, *keys: str, fold: bool = True) -> DataFrame:
    """total, critical … info and total_known (known severities only) per ``keys``.

    With ``fold`` off only severities written in capitals count, as in results of the static scan alone.
    """
    weight = _weight(found)
    known = (F.upper('severity') if fold else F.col('severity')).isin(dim.SEVERITIES)
    return found.groupBy(*keys).agg(
        risk.total(weight), *risk.severity_counts(F.col('severity'), weight, fold),
        F.coalesce(F.sum(F.when(known, F.lit(1) if weight is None else weight)), F.lit(0))
        .cast('bigint').alias('total_known'))


def severity_rollup(found: DataFrame, outer: str = 'repo', inner: str = 'path') -> DataFrame:
    """Counts per file, per repository and overall in one pass; ``level`` tells them apart."""
    per_file = by_severity(found, outer, inner)
    sums = [F.sum(c).cast('bigint').alias(c) for c in ['total', *COUNTS]]
    return (per_file.rollup(outer, inner).agg(*sums, F.grouping_id().cast('bigint').alias('level')))


def by_type(found: DataFrame, *keys: str) -> DataFrame:
    """Histogram by finding type; a missing type counts as UNKNOWN."""
    weight = _weight(found)
    kind = F.coalesce('vulnerability_type', F.lit('UNKNOWN')).alias('vulnerability_type')
    return found.groupBy(*keys, kind).agg(risk.total(weight).alias('n'))


def languages(files: DataFrame, *keys: str) -> DataFrame:
    """Sorted distinct non-empty languages per ``keys``, and how many there are (none: an empty list)."""
    return files.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.nullif('language', F.lit('')))).alias('languages')).withColumn(
        'n_languages', F.size('languages').cast('bigint'))


def success_rate(discovered: DataFrame, analyzed: DataFrame, *keys: str) -> DataFrame:
    """Discovered and analyzed files per ``keys`` and the percentage analyzed (0 without files)."""
    done = analyzed.select(*keys, 'path').distinct().withColumn('_done', F.lit(1))
    counts = discovered.join(done, [*keys, 'path'], 'left').groupBy(*keys).agg(
        F.count(F.lit(1)).alias('discovered'), F.count('_done').alias('analyzed'))
    rate = F.when(F.col('discovered') > 0, F.col('analyzed') / F.col('discovered') * 100)
    return counts.withColumn('success_rate', F.coalesce(rate, F.lit(0.0)))


def file_scores(found: DataFrame, *keys: str) -> DataFrame:
    weight = _weight(found)
    unit = risk.risk_weight(F.col('severity'))
    return found.groupBy(*keys).agg(
        F.sum(unit if weight is None else unit * weight).cast('bigint').alias('score'))


def repo_scores(found: DataFrame, dependency_risk: DataFrame, key: str = 'repo') -> DataFrame:
    """Sum of file scores plus the dependency risk; repositories may occur on either side only."""
    scores = file_scores(found, key).withColumnRenamed('score', 'file_score')
    return (scores.join(dependency_risk, key, 'full_outer').select(
        key, F.coalesce('file_score', F.lit(0)).alias('file_score'),
        F.coalesce('dependency_risk', F.lit(0)).alias('dependency_risk'))
        .withColumn('repo_score', F.col('file_score') + F.col('dependency_risk')))


def breakdown(found: DataFrame) -> DataFrame:
    """severity -> type -> findings, flat: every finding with the size of its group.

    Group sizes are aggregated first. The findings stay where they are if there are at most
    ``FEW_GROUPS`` groups, which then are broadcast; else both sides are joined by a shuffle.
    """
    keys = ['severity', 'vulnerability_type']
    sizes = checkpointed(found.groupBy(*[F.col(k).alias(f'_{k}') for k in keys]).agg(
        F.count(F.lit(1)).alias('group_size')))
    if sizes.count() <= FEW_GROUPS:
        sizes = F.broadcast(sizes)
    same = F.col(keys[0]).eqNullSafe(F.col('_' + keys[0])) & F.col(keys[1]).eqNullSafe(
        F.col('_' + keys[1]))
    return found.join(sizes, same).drop(*['_' + k for k in keys])


def severity_share(counts: DataFrame, *keys: str) -> DataFrame:
    """One row per severity with its count and percentage; nothing for an all-zero row."""
    total = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    rows = F.array(*[F.struct(F.lit(c.upper()).alias('severity'), F.col(c).alias('n')) for c in COUNTS])
    return (counts.withColumn('_total', total).filter('_total > 0')
            .select(*keys, '_total', F.inline(rows))
            .withColumn('share', F.col('n') / F.col('_total') * 100).drop('_total'))


def model_usage(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests used per model and day against the model's daily limit."""
    used = requests.groupBy('model', F.to_date('ts').alias('day')).agg(
        F.count(F.lit(1)).alias('requests_used'))
    return used.join(limits, 'model').select(
        'model', 'day', 'requests_used', 'daily_limit',
        (F.col('requests_used') / F.col('daily_limit') * 100).alias('usage_percent'),
        (F.col('requests_used') < F.col('daily_limit')).alias('can_make_request')).withColumn(
        'status_line', status_line(*[F.col(c) for c in ('model', 'requests_used', 'daily_limit')]))


def status_line(model: Column, used: Column, limit: Column) -> Column:
    """Use of a model as text; tenths of a percent, halves rounded up."""
    tenths = F.floor((used * 2000 + limit) / (limit * 2))
    return F.format_string('- %s: %d/%d (%d.%d%%)', model, used, limit, F.floor(tenths / 10), F.pmod(tenths, F.lit(10)))


def merge_meta(static: DataFrame, ai: DataFrame, merged: DataFrame, keys=('repo', 'path')) -> DataFrame:
    """Numbers of static, model and merged findings per file, and how they came about.

    A file with a critical static finding was not sent to a model; neither was one without replies.
    """
    def count(df, name):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    stat = static.groupBy(*keys).agg(F.count(F.lit(1)).alias('static_issues'))
    out = (stat.join(count(ai, 'ai_issues'), list(keys), 'full_outer')
           .join(count(merged, 'merged_total'), list(keys), 'full_outer').na.fill(0))
    return out.withColumn('method', F.when(F.col('ai_issues') > 0, 'static_plus_ai')
                          .otherwise('static_only'))


def top_types(found: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Most frequent types; equal counts keep the order of first appearance (smallest ``ord``)."""
    counts = found.groupBy(*keys, 'vulnerability_type').agg(
        F.count(F.lit(1)).alias('n'), F.min('ord').alias('first_ord'))
    order = [F.desc('n'), F.asc('first_ord')]
    if not keys:
        return counts.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return counts.withColumn('position', rank).filter(F.col('position') <= n)


def executive_summary(files: DataFrame, found: DataFrame, ladder: str = 'codebase',
                      key: str = 'repo') -> DataFrame:
    """One row per repository: risk, counts, files, languages, most common types."""
    # Counted per file first: the same pass yields the number of files with findings.
    names = ['total', *COUNTS, 'total_known']
    counts = by_severity(found, key, 'path').groupBy(key).agg(
        *[F.sum(c).cast('bigint').alias(c) for c in names], F.count(F.lit(1)).alias('files_with_issues'))
    per_repo = files.groupBy(key).agg(
        F.countDistinct('path').alias('files_analyzed'),
        F.array_join(F.array_sort(F.collect_set(F.nullif('language', F.lit('')))), ',').alias('languages'))
    # At most five entries per repository are collected here.
    common = top_types(found, [key]).groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct('position', F.coalesce('vulnerability_type', F.lit('UNKNOWN')).alias('t')))),
        lambda x: x['t']), ',').alias('most_common'))
    joined = per_repo.join(counts, key, 'left').join(common, key, 'left')
    return (joined.na.fill(0, ['total', 'total_known', *COUNTS, 'files_with_issues'])
            .na.fill('', ['most_common']).withColumn('risk_level', risk.ladder(ladder)))
