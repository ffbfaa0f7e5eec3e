"""Report and dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codefindings.functions import risk
from codefindings.functions.naming import basename, with_display
from codefindings.operators import aggregate, ranking


def overview(files: DataFrame, found: DataFrame, key: str = 'repo') -> DataFrame:
    """Counts, report score, level and files analyzed, one row per repository."""
    per_tree = files.groupBy(key).agg(F.countDistinct('path').alias('files_analyzed'))
    counts = aggregate.by_severity(found, key).drop('total_known')
    out = (per_tree.join(counts, key, 'left').na.fill(0, ['total', *aggregate.COUNTS])
           .withColumn('risk_score', risk.report_score()))
    return out.withColumns(risk.report_level(F.col('risk_score')))


def details(found: DataFrame) -> DataFrame:
    """Findings in report order with snippet, advice and confidence in percent."""
    return ranking.report_order(found).select(
        'repo', 'path', 'position', 'severity', 'vulnerability_type', 'line_number', 'description',
        'code_snippet', 'fix_suggestion',
        risk.confidence_percent(F.col('confidence')).alias('confidence_percent'))


def dashboard(files: DataFrame, found: DataFrame, stored: DataFrame, key: str = 'repo') -> DataFrame:
    """Cards: files, issues, critical issues and languages per repository.

    A stored summary value of 0 or none falls back to the number counted from the findings.
    """
    named = with_display(files.withColumn('filename', basename(F.col('path'))))
    per_tree = named.groupBy(key).agg(F.countDistinct('path').alias('files'),
                                      F.countDistinct('display_name').alias('languages'))
    counts = found.groupBy(key).agg(
        F.count(F.lit(1)).alias('_total'), F.count_if(F.col('severity') == 'CRITICAL').alias('_critical'))

    def either(kept: str, counted: str) -> Column:
        return F.coalesce(F.nullif(kept, F.lit(0)), F.col(counted), F.lit(0))
    return (per_tree.join(counts, key, 'left').join(stored, key, 'left').select(
        key, 'files', 'languages', either('total_vulnerabilities', '_total').alias('issues'),
        either('critical_count', '_critical').alias('critical')))


def alerts(summaries: DataFrame, key: str = 'repo') -> DataFrame:
    """Alert rows for summaries with a critical or high finding, with the payload as JSON."""
    link = F.col('link') if 'link' in summaries.columns else F.lit(None).cast('string')
    parts = risk.alert_payload(F.col(key), F.col('critical'), F.col('high'), link)
    shaped = (summaries.filter((F.col('critical') > 0) | (F.col('high') > 0))
              .withColumns(parts))
    attachment = F.struct(F.col('colour').alias('color'), 'title', 'text')
    return shaped.withColumn('payload', F.to_json(F.struct(
        F.col('title').alias('text'), F.array(attachment).alias('attachments'))))

