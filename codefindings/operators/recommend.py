"""Recommendation lists from the counts of a scan. Keys identify the rules; the texts are ours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TEXTS = {
    'urgent_critical': 'Critical findings: fix them before anything else',
    'fix_high': 'High findings: fix them within one or two days',
    'plan_medium': 'Many medium findings: schedule them for the next cycle',
    'automate': 'Run the scan on every build',
    'training': 'Plan a code review session on the patterns found',
    'static_tools': 'Add a second static analysis tool',
    'incremental': 'Large repository: scan changed files only',
    'all_good': 'Nothing serious found: keep reviewing regularly',
}

# Report rules: key -> (priority, title, description, action, impact).
REPORT = {
    'critical': ('URGENT', 'Resolve critical findings', 'At least one finding can be exploited directly',
                 'Fix within a day', 'Closes the most dangerous holes'),
    'high': ('HIGH', 'Resolve high findings', 'Findings that need little effort to exploit',
             'Fix within two weeks', 'Removes most of the remaining risk'),
    'sql': ('CRITICAL', 'Bind query parameters', 'Statements are put together from strings',
            'Stop building SQL from strings', 'Input can no longer change a statement'),
    'secrets': ('CRITICAL', 'Move secrets out of the code', 'Keys or passwords are in the source',
                'Use a secret store', 'A leaked source no longer opens other systems'),
    'scanning': ('MEDIUM', 'Scan automatically', 'Findings come up late when scans are started by hand',
                 'Add the scan to the build', 'New findings are seen the day they are written'),
    'training': ('MEDIUM', 'Train developers', 'The same patterns come back',
                 'Teach the patterns that were found', 'Fewer findings per change'),
}
REPORT_SHOWN = 5


def _list(*entries: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(key)) for test, key in entries]))


def _serious() -> Column:
    return F.col('critical') + F.col('high') + F.col('medium') > 0


def codebase() -> Column:
    """Ordered rule keys for an archive scan."""
    c, h, m = F.col('critical'), F.col('high'), F.col('medium')
    return _list((c > 0, 'urgent_critical'), (h > 0, 'fix_high'), (m > 3, 'plan_medium'),
                 (_serious(), 'automate'), (_serious(), 'training'), (~_serious(), 'all_good'),
                 (F.lit(True), 'static_tools'))


def repository() -> Column:
    """Ordered rule keys for a repository scan; needs ``files_analyzed``."""
    c, h, m, files = F.col('critical'), F.col('high'), F.col('medium'), F.col('files_analyzed')
    return _list((c > 0, 'urgent_critical'), (h > 0, 'fix_high'), (m > 10, 'plan_medium'),
                 (_serious(), 'automate'), (_serious(), 'training'), (_serious(), 'static_tools'),
                 (files > 100, 'incremental'), (~_serious() & (files <= 100), 'all_good'))


def report() -> Column:
    """All report rule keys in order; needs flags critical_sql and critical_secrets."""
    return _list((F.col('critical') > 0, 'critical'), (F.col('high') > 0, 'high'),
                 (F.col('critical_sql'), 'sql'), (F.col('critical_secrets'), 'secrets'),
                 (F.lit(True), 'scanning'), (F.lit(True), 'training'))


def text_of(key: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast('string'))
    for name, text in TEXTS.items():
        expr = expr.when(key == name, text)
    return expr


ENTRY = ['priority', 'title', 'description', 'action', 'impact']


def report_entry(key: Column) -> Column:
    """The ``ENTRY`` texts of a report rule key, as a struct."""
    expr = F.when(F.lit(False), F.lit(None).cast('struct<' + ','.join(f'{n}:string' for n in ENTRY) + '>'))
    for name, texts in REPORT.items():
        expr = expr.when(key == name, F.struct(*[F.lit(t).alias(n) for n, t in zip(ENTRY, texts)]))
    return expr
