"""Ladders over every small combination of counts, scores, display values and edge cases."""

import itertools

from pyspark.sql import functions as F

from codefindings.functions import risk
from codefindings.operators import aggregate, merge, recommend

COMBOS = list(itertools.product(range(2), range(7), range(12), range(9)))


def level(name, c, h, m, low):
    if c:
        return 'CRITICAL'
    if name == 'repository':
        if h >= 5:
            return 'HIGH'
        if h >= 2 or (h == 1 and m >= 5):
            return 'MEDIUM'
        return 'LOW' if h == 1 or m >= 10 else 'MINIMAL'
    if h >= 2 or (h == 1 and m >= 3):
        return 'HIGH'
    if (h == 1 and name != 'ui_badge') or m >= 5:
        return 'MEDIUM'
    if m >= 2 or (name == 'codebase' and m == 1 and low >= 3):
        return 'LOW'
    return 'MINIMAL'


def test_ladders_and_lists(spark):
    df = spark.createDataFrame([(*x, 101 if x[3] % 2 else 100) for x in COMBOS],
                               'critical long, high long, medium long, low long, files_analyzed long')
    names = ['codebase', 'repository', 'ui_summary', 'ui_badge']
    out = df.select('*', *[risk.ladder(n).alias(n) for n in names], recommend.codebase().alias('rc'),
                    recommend.repository().alias('rr')).collect()
    for r in out:
        c, h, m, low = r.critical, r.high, r.medium, r.low
        for n in names:
            assert r[n] == level(n, c, h, m, low), (n, c, h, m, low)
        serious = c + h + m > 0
        assert r.rc == (['urgent_critical'] * (c > 0) + ['fix_high'] * (h > 0) + ['plan_medium'] * (m > 3)
                        + (['automate', 'training'] if serious else ['all_good']) + ['static_tools'])
        want = (['urgent_critical'] * (c > 0) + ['fix_high'] * (h > 0) + ['plan_medium'] * (m > 10)
                + ['automate', 'training', 'static_tools'] * serious + ['incremental'] * (r.files_analyzed > 100))
        assert r.rr == (want or ['all_good'])


def test_missing_and_unknown_severities(spark):
    found = spark.createDataFrame([('a', 'critical'), ('a', None), ('a', ''), ('a', 'ODD'), ('a', 'Info')], 'path string, severity string')
    row = aggregate.by_severity(found, 'path').collect()[0]
    assert (row.total, row.total_known, row.critical, row.info) == (5, 2, 1, 1)
    assert aggregate.file_scores(found, 'path').collect()[0].score == 10 + 1 + 1 + 1 + 1
    assert aggregate.by_severity(found.limit(0)).collect()[0].total == 0
    assert aggregate.severity_share(aggregate.by_severity(found.limit(0))).count() == 0


def test_cvss(spark):
    cases = [([('CVSS_V3', '9.0')], 'CRITICAL'), ([('CVSS_V2', '7.1/x')], 'HIGH'), ([('X', '9.9')], 'LOW'), (None, 'LOW'),
             ([('CVSS_V3', 'CVSS:3.1/AV'), ('CVSS_V2', '4')], 'MEDIUM'), ([('CVSS_V3', 'NaN')], 'LOW'), ([], 'LOW'),
             ([('CVSS_V3', None), ('CVSS_V3', '1')], 'LOW'), ([('CVSS_V3', '3.99'), ('CVSS_V3', '9')], 'LOW')]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], 'i int, s array<struct<type:string,score:string>>')
    for r in df.select('i', risk.cvss_bucket(F.col('s')).alias('b')).collect():
        assert r.b == cases[r.i][1], cases[r.i]


def test_merge_keeps_static_and_first_model_rows(spark):
    schema = 'repo string, path string, line_number int, vulnerability_type string, severity string, ord int'
    frame = lambda rows: spark.createDataFrame([('r', *row) for row in rows], schema)
    static = frame([('a', 1, 'X', 'HIGH', 0), ('a', 1, 'X', 'HIGH', 1), ('a', 9, None, 'LOW', 2)])
    ai = frame([('a', 1, 'X', 'LOW', 0), ('a', 2, 'X', 'LOW', 2), ('a', 2, 'X', 'HIGH', 1), ('b', 1, 'X', 'LOW', 5),
                ('a', 9, None, 'HIGH', 6)])
    got = sorted((r.path, r.line_number, r.severity, r.ord) for r in merge.merge(static, ai).collect())
    assert got == [('a', 1, 'HIGH', 0), ('a', 1, 'HIGH', 1), ('a', 2, 'HIGH', 1), ('a', 9, 'LOW', 2), ('b', 1, 'LOW', 5)]
    other = ai.withColumn('repo', F.lit('other'))
    assert merge.merge(static, other).filter("repo = 'other'").count() == 4


def test_elapsed_and_progress(spark):
    df = spark.createDataFrame([('2024-01-01T00:00:01',), ('2024-01-01T00:00:00.5',), ('2023-12-31T23:50:00',), ('x',), (None,)], 't string')
    parts = risk.elapsed(F.col('t'), F.lit('2024-01-01 00:00:02').cast('timestamp_ntz'))
    got = [(r.elapsed_text, r.elapsed_unit) for r in df.select(*[c.alias(n) for n, c in parts.items()]).collect()]
    assert got == [('1.0 seconds', 'seconds'), ('1.5 seconds', 'seconds'), ('10.0 minutes', 'minutes'), ('Unknown', 'Unknown'), ('Unknown', 'Unknown')]


def test_alert_payload_is_json(spark):
    from codefindings.plans.report import alerts
    df = spark.createDataFrame([('r', 0, 2, 'http://x'), ('s', 0, 0, None), ('t', 1, 0, None)], 'repo string, critical int, high int, link string')
    rows = {r.repo: r for r in alerts(df).collect()}
    assert set(rows) == {'r', 't'} and rows['r'].severity == 'HIGH' and rows['t'].severity == 'CRITICAL'
    assert rows['r'].text.endswith('\n<http://x|View details>') and '"color":"#fd7e14"' in rows['r'].payload
