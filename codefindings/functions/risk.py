"""Severity counts, scores, risk ladders and display values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codefindings.dims import limits, severity as dim
from codefindings.functions.naming import lookup


def severity_counts(severity: Column, weight: Column | None = None, fold: bool = True) -> list[Column]:
    """Aggregates critical … info, ignoring case unless ``fold`` is off. ``weight`` counts pre-grouped rows."""
    unit = F.lit(1) if weight is None else weight
    upper = F.upper(severity) if fold else severity
    return [F.coalesce(F.sum(F.when(upper == s, unit)), F.lit(0)).cast('bigint')
            .alias(s.lower()) for s in dim.SEVERITIES]


def total(weight: Column | None = None) -> Column:
    counted = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    return counted.cast('bigint').alias('total')


def risk_weight(severity: Column) -> Column:
    """10/5/2/1; a missing severity counts as LOW and an unknown one as 1."""
    key = F.upper(F.coalesce(F.nullif(severity, F.lit('')), F.lit('LOW')))
    return F.coalesce(weight_of(dim.RISK_WEIGHTS, key), F.lit(1)).cast('bigint')


def weight_of(weights: dict[str, int], severity: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast('int'))
    for name, value in weights.items():
        expr = expr.when(severity == name, value)
    return expr


def weighted(weights: dict[str, int]) -> Column:
    """Weighted sum over the count columns critical, high, medium, low."""
    expr = F.lit(0).cast('bigint')
    for name, value in weights.items():
        expr = expr + F.col(name.lower()) * value
    return expr


def report_score() -> Column:
    return F.least(weighted(dim.REPORT_WEIGHTS), F.lit(100).cast('bigint'))


def dashboard_score() -> Column:
    return weighted(dim.DASHBOARD_WEIGHTS)


def ladder(name: str) -> Column:
    """Risk level from the count columns critical, high, medium, low."""
    expr = F.when(F.lit(False), F.lit(None).cast('string'))
    for condition, level in dim.LADDERS[name]:
        test = ' '.join({'c': 'critical', 'h': 'high', 'm': 'medium', 'l': 'low'}.get(w, w)
                        for w in condition.split())
        expr = expr.when(F.expr(test), level)
    return expr.otherwise(dim.LOWEST_LEVEL)


def report_level(score: Column) -> dict[str, Column]:
    level, colour = F.when(F.lit(False), ''), F.when(F.lit(False), '')
    for floor, name, shade in dim.REPORT_LEVELS[:-1]:
        level, colour = level.when(score >= floor, name), colour.when(score >= floor, shade)
    level, colour = (e.otherwise(v) for e, v in zip((level, colour), dim.REPORT_LEVELS[-1][1:]))
    return {'risk_level': level, 'colour': colour,
            'level_text': lookup(dim.REPORT_LEVEL_TEXT, level)}


def report_rank(severity: Column) -> Column:
    """CRITICAL 0 … INFO 4, anything else 5."""
    return F.coalesce(weight_of({s: i for i, s in enumerate(dim.SEVERITIES)}, severity),
                      F.lit(dim.UNKNOWN_RANK)).cast('bigint')


def ui_rank(severity: Column) -> Column:
    """CRITICAL 5 … INFO 1; NULL for anything else."""
    return weight_of({s: 5 - i for i, s in enumerate(dim.SEVERITIES)}, severity).cast('bigint')


def cvss_bucket(severities: Column) -> Column:
    """Bucket of the first advisory score that parses as a number; LOW without one."""
    def number(s):
        return F.split_part(s['score'], F.lit('/'), F.lit(1)).try_cast('double')
    typed = F.filter(severities, lambda s: s['type'].isin(dim.CVSS_TYPES))
    score = F.get(F.filter(F.transform(typed, number), lambda x: x.isNotNull()), 0)
    expr = F.when(score.isNull() | F.isnan(score), 'LOW')
    for floor, bucket in dim.CVSS_BUCKETS:
        expr = expr.when(score >= floor, bucket)
    return expr.otherwise('LOW')


def alert_payload(repo: Column, critical: Column, high: Column, link: Column) -> dict[str, Column]:
    c, h = critical.cast('string'), high.cast('string')
    severity = F.when(critical > 0, 'CRITICAL').otherwise('HIGH')
    suffix = F.coalesce(F.concat(F.lit('\n<'), link, F.lit('|View details>')), F.lit(''))
    return {
        'title': F.concat(F.lit('Security Alert: '), repo, F.lit(' — '), c, F.lit(' critical, '),
                          h, F.lit(' high')),
        'text': F.concat(F.lit('Repository '), repo,
                         F.lit(' has critical/high findings. Critical: '), c,
                         F.lit(', High: '), h, F.lit('.'), suffix),
        'severity': severity,
        'colour': alert_colour(severity),
    }


def alert_colour(severity: Column) -> Column:
    key = F.upper(F.coalesce(severity, F.lit('INFO')))
    return F.coalesce(lookup(dim.ALERT_COLOURS, key), F.lit(dim.DEFAULT_COLOUR))


def ui_colour(severity: Column) -> Column:
    return F.coalesce(lookup(dim.UI_COLOURS, severity), F.lit(dim.DEFAULT_COLOUR))


def type_icon(kind: Column) -> Column:
    return F.coalesce(lookup(dim.TYPE_ICONS, kind), F.lit(dim.DEFAULT_ICON))


def heat_colour(value: Column) -> Column:
    (top, red), *rest = dim.HEAT_COLOURS
    expr = F.when(value >= top, red)
    for exact, shade in rest:
        expr = expr.when(value == exact, shade)
    return expr.otherwise(dim.HEAT_SAFE)


def short_label(name: Column) -> Column:
    return F.when(F.length(name) > 15, F.concat(F.substring(name, 1, 12), F.lit('...'))).otherwise(name)


def type_label(kind: Column) -> Column:
    return F.replace(kind, F.lit('_'), F.lit(' '))


def confidence_percent(confidence: Column) -> Column:
    return F.round(confidence * 100).cast('bigint')


def history_progress(created: Column, now: Column, status: Column, stored: Column,
                     file_count: Column) -> Column:
    """Progress of a scan: stored value, or an estimate from elapsed time capped at 85."""
    elapsed = seconds_between(created, now)
    expected = F.nullif(file_count * limits.SECONDS_PER_FILE, F.lit(0))
    guess = F.least((elapsed / expected * 100).cast('bigint'), F.lit(limits.PROGRESS_CEILING))
    return (F.when(status == 'completed', 100).when(status == 'failed', 0)
            .when(stored > 0, stored).otherwise(guess).cast('bigint'))


def seconds_between(start: Column, end: Column) -> Column:
    """Difference of two (zone-less or instant) timestamps in seconds, to the microsecond."""
    return F.timestamp_diff('MICROSECOND', start, end) / F.lit(1e6)


def elapsed(start_text: Column, now: Column) -> dict[str, Column]:
    """Elapsed time since an ISO timestamp: value, unit and display text."""
    seconds = seconds_between(F.try_to_timestamp(start_text).cast('timestamp_ntz'), now)
    value = F.when(seconds < 60, seconds).otherwise(seconds / 60)
    unit = F.when(seconds.isNull(), 'Unknown').when(seconds < 60, 'seconds').otherwise('minutes')
    return {'elapsed_value': value, 'elapsed_unit': unit,
            'elapsed_text': F.when(seconds.isNull(), 'Unknown').otherwise(
                F.concat(F.format_string('%.1f', value), F.lit(' '), unit))}
