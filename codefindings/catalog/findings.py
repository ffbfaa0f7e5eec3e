"""Queries: merging, roll-ups, scores, risk ladders, recommendations, rankings and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefindings import bindings as b
from codefindings.bindings import quoted, with_sql
from codefindings.catalog.registry import query
from codefindings.dims import limits, severity as sev
from codefindings.functions import risk
from codefindings.operators import (aggregate, dependencies, evaluate, filters, merge, ranking, recommend)

COUNTS = ['critical', 'high', 'medium', 'low', 'info']
COUNTS_SQL = 'count(*) AS total, ' + ', '.join(
    f"count(*) FILTER (upper(severity) = '{c.upper()}') AS {c}" for c in COUNTS)
KNOWN_SQL = "count(*) FILTER (upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO')) AS total_known"

# Small scans, so that every rung of the ladders is reached: the findings of one file on one day.
SCANS_SQL = b.FINDINGS_SQL + f""",
scans AS (SELECT path, strftime(found_at, '%Y-%m-%d') AS day, {COUNTS_SQL}, count(DISTINCT line_number) * 9 AS files_analyzed,
  count(*) FILTER (severity = 'CRITICAL' AND vulnerability_type = 'SQL_INJECTION') > 0 AS critical_sql,
  count(*) FILTER (severity = 'CRITICAL' AND vulnerability_type = 'HARDCODED_SECRETS') > 0 AS critical_secrets
  FROM findings GROUP BY ALL)"""


def scans(spark, sf):
    found = b.findings(spark, sf).withColumn('day', F.date_format('found_at', 'yyyy-MM-dd'))
    critical = F.col('severity') == 'CRITICAL'

    def has(kind):
        both = critical & (F.col('vulnerability_type') == kind)
        return F.count_if(both) > 0
    return found.groupBy('path', 'day').agg(
        risk.total(), *risk.severity_counts(F.col('severity')),
        (F.countDistinct('line_number') * 9).alias('files_analyzed'),
        has('SQL_INJECTION').alias('critical_sql'), has('HARDCODED_SECRETS').alias('critical_secrets'))


# ---- roll-ups ------------------------------------------------------------------------------
@query('agg_severity_file', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT repo, path, {COUNTS_SQL}, {KNOWN_SQL}, count(*) FILTER (severity = 'CRITICAL') > 0 AS critical_issues
FROM findings GROUP BY repo, path"""))
def agg_severity_file(spark, sf):
    return aggregate.by_severity(b.findings(spark, sf), 'repo', 'path').withColumn(
        'critical_issues', F.col('critical') > 0)


_MIXED_CASE = "SELECT repo, CASE WHEN ord % 5 = 0 THEN lower(severity) ELSE severity END AS severity FROM findings"


@query('agg_severity_literal', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT repo, count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{c.upper()}') AS {c}" for c in COUNTS)},
  count(*) FILTER (severity IN ({', '.join(f"'{c.upper()}'" for c in COUNTS)})) AS total_known FROM ({_MIXED_CASE}) GROUP BY repo"""))
def agg_severity_literal(spark, sf):
    found = b.findings(spark, sf)
    mixed = found.withColumn('severity', F.when(F.col('ord') % 5 == 0, F.lower('severity')).otherwise(F.col('severity')))
    return aggregate.by_severity(mixed, 'repo', fold=False)


@query('agg_severity_repo', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT repo, {COUNTS_SQL}, {KNOWN_SQL} FROM findings GROUP BY repo"""))
def agg_severity_repo(spark, sf):
    return aggregate.by_severity(b.findings(spark, sf), 'repo')


@query('agg_severity_rollup', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT repo, path, {COUNTS_SQL}, CAST(grouping(repo, path) AS BIGINT) AS level
FROM findings GROUP BY ROLLUP (repo, path)"""))
def agg_severity_rollup(spark, sf):
    return aggregate.severity_rollup(b.findings(spark, sf))


@query('agg_types', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT repo, coalesce(vulnerability_type, 'UNKNOWN') AS vulnerability_type, count(*) AS n
FROM findings GROUP BY ALL"""))
def agg_types(spark, sf):
    return aggregate.by_type(b.findings(spark, sf), 'repo')


@query('agg_languages', sql=with_sql(b.ANALYZED_SQL, body="""
SELECT repo, coalesce(string_agg(DISTINCT nullif(language, ''), ',' ORDER BY nullif(language, '')), '') AS languages,
  count(DISTINCT nullif(language, '')) AS n_languages
FROM (SELECT repo, language FROM analyzed_files UNION ALL SELECT 'nameless', '' FROM analyzed_files) GROUP BY repo"""))
def agg_languages(spark, sf):
    files = b.analyzed_files(spark, sf).select('repo', 'language')
    files = files.unionByName(files.select(F.lit('nameless').alias('repo'), F.lit('').alias('language')))
    return aggregate.languages(files, 'repo').withColumn(
        'languages', F.array_join('languages', ','))


_COVERAGE = with_sql(b.ANALYZED_SQL, b.FINDINGS_SQL, body="""
SELECT a.repo, count(*) AS discovered, count(f.path) AS analyzed,
  CAST(count(f.path) AS DOUBLE) / count(*) * 100 AS success_rate
FROM analyzed_files a LEFT JOIN (SELECT DISTINCT repo, path FROM findings) f
  ON a.repo = f.repo AND a.path = f.path GROUP BY a.repo""")


@query('agg_success_rate', sql=_COVERAGE)
def agg_success_rate(spark, sf):
    return aggregate.success_rate(b.analyzed_files(spark, sf), b.findings(spark, sf), 'repo')


@query('discovered_vs_analyzed', sql=with_sql(b.ANALYZED_SQL, b.FINDINGS_SQL, body="""
SELECT repo, path, (repo, path) IN (SELECT (repo, path) FROM findings) AS analyzed FROM analyzed_files"""))
def discovered_vs_analyzed(spark, sf):
    done = b.findings(spark, sf).select('repo', 'path').distinct().withColumn('analyzed', F.lit(True))
    return b.analyzed_files(spark, sf).join(done, ['repo', 'path'], 'left').select(
        'repo', 'path', F.coalesce('analyzed', F.lit(False)).alias('analyzed'))


@query('files_left_findings', sql=with_sql(b.ANALYZED_SQL, b.FINDINGS_SQL, body="""
SELECT a.repo, a.path, count(f.path) AS n_findings FROM analyzed_files a LEFT JOIN findings f ON a.repo = f.repo AND a.path = f.path
GROUP BY a.repo, a.path"""))
def files_left_findings(spark, sf):
    return merge.with_finding_counts(b.analyzed_files(spark, sf), b.findings(spark, sf)).select(
        'repo', 'path', 'n_findings')


RISK_SQL = """CASE upper(coalesce(nullif(severity, ''), 'LOW')) WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5
  WHEN 'MEDIUM' THEN 2 ELSE 1 END"""


@query('score_file', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT repo, path, CAST(sum({RISK_SQL}) AS BIGINT) AS score FROM findings GROUP BY repo, path"""))
def score_file(spark, sf):
    return aggregate.file_scores(b.findings(spark, sf), 'repo', 'path')


def dependency_risk(spark, sf):
    return dependencies.risk_by_repo(dependencies.all_dependencies(b.manifests(spark, sf)), b.advisories(spark, sf))


@query('score_report', sql=with_sql(SCANS_SQL, body="""
SELECT path, day, least(25 * critical + 15 * high + 8 * medium + 3 * low, 100) AS score FROM scans"""))
def score_report(spark, sf):
    return scans(spark, sf).select('path', 'day', risk.report_score().alias('score'))


@query('score_dashboard', sql=with_sql(SCANS_SQL, body="""
SELECT path, day, 40 * critical + 20 * high + 8 * medium + 2 * low AS score,
  least(40 * critical + 20 * high + 8 * medium + 2 * low, 100) AS gauge FROM scans"""))
def score_dashboard(spark, sf):
    score = risk.dashboard_score()
    return scans(spark, sf).select('path', 'day', score.alias('score'),
                                   F.least(score, F.lit(100).cast('bigint')).alias('gauge'))


@query('agg_breakdown', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT severity, vulnerability_type, path, line_number, description,
  count(*) OVER (PARTITION BY severity, vulnerability_type) AS group_size FROM findings"""))
def agg_breakdown(spark, sf):
    return aggregate.breakdown(b.findings(spark, sf)).select(
        'severity', 'vulnerability_type', 'path', 'line_number', 'description', 'group_size')


@query('agg_severity_share', sql=with_sql(b.FINDINGS_SQL, f"""counts AS (
  SELECT repo, {COUNTS_SQL} FROM findings GROUP BY repo)""", body=' UNION ALL '.join(f"""
SELECT repo, '{c.upper()}' AS severity, {c} AS n,
  CAST({c} AS DOUBLE) / (critical + high + medium + low + info) * 100 AS share FROM counts""" for c in COUNTS)))
def agg_severity_share(spark, sf):
    return aggregate.severity_share(aggregate.by_severity(b.findings(spark, sf), 'repo'), 'repo')


def model_limits(spark):
    return spark.createDataFrame(limits.model_limits(b.MODELS),
                                 'model string, preference int, daily_limit int')


LIMITS_SQL = 'limits(model, preference, daily_limit) AS (VALUES ' + ', '.join(
    f'({quoted(m)}, {p}, {n})' for m, p, n in limits.model_limits(b.MODELS)) + ')'


@query('agg_model_usage', sql=with_sql(b.REQUESTS_SQL, LIMITS_SQL, body="""
SELECT model, strftime(day, '%Y-%m-%d') AS day, n AS requests_used, daily_limit,
  CAST(n AS DOUBLE) / daily_limit * 100 AS usage_percent, n < daily_limit AS can_make_request,
  printf('- %s: %d/%d (%d.%d%%)', model, n, daily_limit, (n * 2000 + daily_limit) // (2 * daily_limit) // 10,
    (n * 2000 + daily_limit) // (2 * daily_limit) % 10) AS status_line
FROM (SELECT model, CAST(ts AS DATE) AS day, count(*) AS n FROM requests GROUP BY ALL) JOIN limits USING (model)"""))
def agg_model_usage(spark, sf):
    return aggregate.model_usage(b.requests(spark, sf), model_limits(spark)).withColumn(
        'day', F.date_format('day', 'yyyy-MM-dd'))


MERGED_SQL = """first_ai AS (SELECT * FROM ai_findings
  QUALIFY row_number() OVER (PARTITION BY repo, path, line_number, vulnerability_type ORDER BY ord) = 1),
merged AS (SELECT * FROM static_findings UNION ALL BY NAME SELECT * FROM first_ai a
  WHERE NOT EXISTS (SELECT 1 FROM static_findings s WHERE s.repo = a.repo AND s.path = a.path AND s.line_number = a.line_number
    AND s.vulnerability_type IS NOT DISTINCT FROM a.vulnerability_type))"""


@query('join_merge_findings', sql=with_sql(b.STATIC_AI_SQL, MERGED_SQL, body="""
SELECT repo, path, line_number, vulnerability_type, severity, ord FROM merged"""))
def join_merge_findings(spark, sf):
    return merge.merge(*b.static_and_ai(spark, sf)).select(
        'repo', 'path', 'line_number', 'vulnerability_type', 'severity', 'ord')


@query('win_dedupe_first', sql=with_sql(b.STATIC_AI_SQL, MERGED_SQL, body="""
SELECT repo, path, line_number, vulnerability_type, severity, ord FROM first_ai"""))
def win_dedupe_first(spark, sf):
    return merge.first_per_place(b.static_and_ai(spark, sf)[1]).select(
        'repo', 'path', 'line_number', 'vulnerability_type', 'severity', 'ord')


# Some files have static findings only.
_META = b.STATIC_AI_SQL.replace('static_findings AS (', """static_findings AS (
  SELECT * REPLACE (path || '.static' AS path) FROM findings WHERE ord % 10 = 0 UNION ALL """)


@query('agg_merge_meta', sql=with_sql(_META, MERGED_SQL, body="""
SELECT repo, path, coalesce(s.n, 0) AS static_issues, coalesce(a.n, 0) AS ai_issues, m.n AS merged_total,
  CASE WHEN a.n > 0 THEN 'static_plus_ai' ELSE 'static_only' END AS method
FROM (SELECT repo, path, count(*) AS n FROM merged GROUP BY ALL) m
LEFT JOIN (SELECT repo, path, count(*) AS n FROM static_findings GROUP BY ALL) s USING (repo, path)
LEFT JOIN (SELECT repo, path, count(*) AS n FROM ai_findings GROUP BY ALL) a USING (repo, path)"""))
def agg_merge_meta(spark, sf):
    static, ai = b.static_and_ai(spark, sf)
    alone = b.findings(spark, sf).filter('ord % 10 = 0').withColumn('path', F.concat('path', F.lit('.static')))
    static = static.unionByName(alone)
    return aggregate.merge_meta(static, ai, merge.merge(static, ai))


@query('agg_ui_summary', sql=with_sql(b.FINDINGS_SQL, b.ANALYZED_SQL, body=f"""
SELECT c.*, files_analyzed, files_with_issues, languages, CASE WHEN c.critical > 0 THEN 'CRITICAL' WHEN c.high >= 2 THEN 'HIGH'
  WHEN c.high = 1 AND c.medium >= 3 THEN 'HIGH' WHEN c.high = 1 THEN 'MEDIUM' WHEN c.medium >= 5 THEN 'MEDIUM'
  WHEN c.medium >= 2 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level
FROM (SELECT repo, {COUNTS_SQL} FROM findings GROUP BY repo) c
JOIN (SELECT repo, count(DISTINCT path) AS files_with_issues FROM findings GROUP BY repo) i USING (repo)
JOIN (SELECT repo, count(DISTINCT path) AS files_analyzed, string_agg(DISTINCT nullif(language, ''), ',' ORDER BY nullif(language, '')) AS languages
      FROM analyzed_files GROUP BY repo) f USING (repo)"""))
def agg_ui_summary(spark, sf):
    return aggregate.executive_summary(b.analyzed_files(spark, sf), b.findings(spark, sf),
                                       'ui_summary').drop('most_common', 'total_known')


@query('agg_executive_summary', sql=with_sql(b.FINDINGS_SQL, b.ANALYZED_SQL, f"""tops AS (
  SELECT repo, string_agg(coalesce(t, 'UNKNOWN'), ',' ORDER BY n DESC, f) AS most_common FROM (
    SELECT repo, vulnerability_type AS t, count(*) AS n, min(ord) AS f FROM findings GROUP BY repo, vulnerability_type
    QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, f) <= 5) GROUP BY repo)""", body=f"""
SELECT c.*, files_analyzed, files_with_issues, languages, most_common,
  CASE WHEN c.critical > 0 THEN 'CRITICAL' WHEN c.high >= 2 THEN 'HIGH'
  WHEN c.high = 1 AND c.medium >= 3 THEN 'HIGH' WHEN c.high = 1 THEN 'MEDIUM' WHEN c.medium >= 5 THEN 'MEDIUM'
  WHEN c.medium >= 2 THEN 'LOW' WHEN c.medium = 1 AND c.low >= 3 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level,
  CASE WHEN c.critical + c.high + c.medium > 0 THEN 'yes' ELSE 'no' END AS serious
FROM (SELECT repo, {COUNTS_SQL}, {KNOWN_SQL} FROM findings GROUP BY repo) c
JOIN (SELECT repo, count(DISTINCT path) AS files_with_issues FROM findings GROUP BY repo) i USING (repo)
JOIN (SELECT repo, count(DISTINCT path) AS files_analyzed, string_agg(DISTINCT nullif(language, ''), ',' ORDER BY nullif(language, '')) AS languages
      FROM analyzed_files GROUP BY repo) f USING (repo) JOIN tops USING (repo)"""))
def agg_executive_summary(spark, sf):
    return aggregate.executive_summary(b.analyzed_files(spark, sf), b.findings(spark, sf)).withColumn(
        'serious', F.when(F.array_contains(recommend.codebase(), 'automate'), 'yes').otherwise('no'))


# ---- ladders and recommendations -----------------------------------------------------------
def _ladder_sql(name):
    rungs = ' '.join('WHEN ' + ' '.join({'c': 'critical', 'h': 'high', 'm': 'medium', 'l': 'low'}.get(w, w)
                                        for w in cond.split()) + f" THEN '{level}'"
                     for cond, level in sev.LADDERS[name])
    return f"CASE {rungs} ELSE '{sev.LOWEST_LEVEL}' END"


def _register_ladder(name, ladder):
    @query(name, sql=with_sql(SCANS_SQL, body=f"""
SELECT path, day, critical, high, medium, low, {_ladder_sql(ladder)} AS risk_level FROM scans"""))
    def run(spark, sf):
        return scans(spark, sf).select('path', 'day', 'critical', 'high', 'medium', 'low',
                                       risk.ladder(ladder).alias('risk_level'))


for _name in ('codebase', 'repository', 'ui_summary', 'ui_badge'):
    _register_ladder('risk_' + _name, _name)

REPORT_SCORE_SQL = 'least(25 * critical + 15 * high + 8 * medium + 3 * low, 100)'


@query('risk_report', sql=with_sql(SCANS_SQL, body=f"""
SELECT path, day, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM'
  WHEN score >= 10 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level,
  CASE WHEN score >= 80 THEN '#dc3545' WHEN score >= 60 THEN '#fd7e14' WHEN score >= 30 THEN '#ffc107'
  WHEN score >= 10 THEN '#28a745' ELSE '#6c757d' END AS colour
FROM (SELECT *, {REPORT_SCORE_SQL} AS score FROM scans)"""))
def risk_report(spark, sf):
    level = risk.report_level(F.col('score'))
    return scans(spark, sf).withColumn('score', risk.report_score()).select(
        'path', 'day', 'score', level['risk_level'].alias('risk_level'), level['colour'].alias('colour'))


def _keys_sql(*entries):
    tests = ', '.join(f"CASE WHEN {test} THEN '{key}' END" for test, key in entries)
    return f'list_filter([{tests}], lambda k: k IS NOT NULL)'


def _recs_sql(keys):
    return with_sql(SCANS_SQL, f'lists AS (SELECT path, day, {keys} AS keys FROM scans)', body="""
SELECT path, day, i AS position, keys[i] AS rule FROM (
  SELECT path, day, keys, unnest(generate_series(1, len(keys))) AS i FROM lists)""")


def _recs(spark, sf, keys):
    return scans(spark, sf).select('path', 'day', F.posexplode(keys).alias('i', 'rule')).select(
        'path', 'day', (F.col('i') + 1).cast('bigint').alias('position'), 'rule')


_S = 'critical + high + medium > 0'


@query('recs_codebase', sql=_recs_sql(_keys_sql(
    ('critical > 0', 'urgent_critical'), ('high > 0', 'fix_high'), ('medium > 3', 'plan_medium'),
    (_S, 'automate'), (_S, 'training'), (f'NOT ({_S})', 'all_good'), ('true', 'static_tools'))))
def recs_codebase(spark, sf):
    return _recs(spark, sf, recommend.codebase())


@query('recs_repository', sql=_recs_sql(_keys_sql(
    ('critical > 0', 'urgent_critical'), ('high > 0', 'fix_high'), ('medium > 10', 'plan_medium'),
    (_S, 'automate'), (_S, 'training'), (_S, 'static_tools'), ('files_analyzed > 100', 'incremental'),
    (f'NOT ({_S}) AND files_analyzed <= 100', 'all_good'))).replace('* 9 AS files_analyzed', '* 30 AS files_analyzed'))
def recs_repository(spark, sf):
    wide = scans(spark, sf).withColumn('files_analyzed', (F.col('files_analyzed') / 9 * 30).cast('bigint'))
    return wide.select('path', 'day', F.posexplode(recommend.repository()).alias('i', 'rule')).select(
        'path', 'day', (F.col('i') + 1).cast('bigint').alias('position'), 'rule')


@query('recs_report', sql=_recs_sql(_keys_sql(
    ('critical > 0', 'critical'), ('high > 0', 'high'), ('critical_sql', 'sql'),
    ('critical_secrets', 'secrets'), ('true', 'scanning'), ('true', 'training'))).replace(
    'keys[i] AS rule FROM', 'keys[i] AS rule, ' + f'i <= {recommend.REPORT_SHOWN} AS shown, ' + ', '.join(
        'CASE keys[i] ' + ' '.join(f'WHEN {quoted(k)} THEN {quoted(v[n])}' for k, v in recommend.REPORT.items())
        + f' END AS {name}' for n, name in enumerate(recommend.ENTRY)) + ' FROM'))
def recs_report(spark, sf):
    entry = recommend.report_entry(F.col('rule'))
    return _recs(spark, sf, recommend.report()).withColumn('shown', F.col('position') <= recommend.REPORT_SHOWN).withColumns(
        {name: entry[name] for name in recommend.ENTRY})


# ---- rankings ------------------------------------------------------------------------------
@query('top_types', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT vulnerability_type, count(*) AS n, min(ord) AS first_ord FROM findings GROUP BY ALL
ORDER BY n DESC, first_ord LIMIT 5"""))
def top_types(spark, sf):
    return aggregate.top_types(b.findings(spark, sf), [])


PROBLEM_SQL = """SELECT repo, path, CAST(sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 ELSE 3 END) AS BIGINT) AS score,
  count(*) AS total_issues, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity IS NULL OR severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS low, min(ord) AS first_ord
FROM findings GROUP BY repo, path ORDER BY score DESC, first_ord LIMIT 5"""


@query('top_problem_files', sql=with_sql(b.FINDINGS_SQL, body=PROBLEM_SQL))
def top_problem_files(spark, sf):
    return ranking.problem_files(b.findings(spark, sf))


SCORED_SQL = f"""scored AS (SELECT a.repo, a.path, CASE WHEN a.language = 'go' THEN 0 ELSE coalesce(s.score, 0) END AS score,
  coalesce(s.n, 0) AS n_findings FROM analyzed_files a LEFT JOIN (
  SELECT repo, path, CAST(sum({RISK_SQL}) AS BIGINT) AS score, count(*) AS n FROM findings GROUP BY repo, path) s USING (repo, path)),
valued AS (SELECT repo, path, coalesce(nullif(score, 0), n_findings) AS value FROM scored)"""


def scored(spark, sf):
    found = b.findings(spark, sf)
    per_file = aggregate.file_scores(found, 'repo', 'path')
    files = merge.with_finding_counts(b.analyzed_files(spark, sf), found)
    return files.join(per_file, ['repo', 'path'], 'left').withColumn(
        'score', F.when(F.col('language') == 'go', 0).otherwise(F.coalesce('score', F.lit(0))))


@query('top_files_bar', sql=with_sql(b.FINDINGS_SQL, b.ANALYZED_SQL, SCORED_SQL, body="""
SELECT repo, path, value FROM valued WHERE value > 0 ORDER BY value DESC, repo, path LIMIT 15"""))
def top_files_bar(spark, sf):
    return ranking.top_files(scored(spark, sf)).select('repo', 'path', 'value')


@query('heatmap_files', sql=with_sql(b.FINDINGS_SQL, b.ANALYZED_SQL, SCORED_SQL, body="""
SELECT repo, path, value, CASE WHEN value >= 3 THEN '#FF3B30' WHEN value = 2 THEN '#FF9500'
  WHEN value = 1 THEN '#FFD60A' ELSE '#34C759' END AS colour
FROM valued ORDER BY value DESC, repo, path LIMIT 25"""))
def heatmap_files(spark, sf):
    return ranking.heatmap(scored(spark, sf)).select('repo', 'path', 'value', 'colour')


REPORT_RANK_SQL = """CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2
  WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END"""


@query('order_findings', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT repo, path, ord, severity, line_number, row_number() OVER (PARTITION BY repo, path
  ORDER BY {REPORT_RANK_SQL}, line_number, ord) AS position FROM findings"""))
def order_findings(spark, sf):
    return ranking.report_order(b.findings(spark, sf)).select(
        'repo', 'path', 'ord', 'severity', 'line_number', 'position')


@query('order_findings_ui', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT repo, path, ord, severity, row_number() OVER (PARTITION BY repo, path ORDER BY CASE severity WHEN 'CRITICAL' THEN 0
  WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END, ord) AS position
FROM findings"""))
def order_findings_ui(spark, sf):
    return ranking.ui_order(b.findings(spark, sf)).select('repo', 'path', 'ord', 'severity', 'position')


@query('recent_commits', sql=with_sql(b.COMMITS_SQL, body="""
SELECT repo, left(sha, 8) AS short_sha, row_number() OVER (PARTITION BY repo ORDER BY date DESC, ord DESC) AS position
FROM commits QUALIFY position <= 5"""))
def recent_commits(spark, sf):
    return ranking.recent_commits(b.commits(spark, sf)).select(
        'repo', F.substring('sha', 1, 8).alias('short_sha'),
        F.col('position').cast('bigint').alias('position'))


HISTORY20_SQL = """SELECT repo_id, ord, repo_score, critical, high, strftime(ts, '%H:%M') AS label
FROM history QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ord DESC) <= 20"""


@query('history_last20', sql=with_sql(b.HISTORY_SQL, body=HISTORY20_SQL))
def history_last20(spark, sf):
    return ranking.recent_history(b.history(spark, sf), ['repo_id']).select(
        'repo_id', 'ord', 'repo_score', 'critical', 'high', 'label')


@query('rate_60s', sql=with_sql(b.REQUESTS_SQL, body="""
SELECT request_id, n AS in_last_minute, n >= 12 AS blocked FROM (
  SELECT request_id, count(*) OVER (PARTITION BY key % 3 ORDER BY epoch_us(ts)
    RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS n FROM requests)"""))
def rate_60s(spark, sf):
    requests = b.requests(spark, sf).withColumn('key', F.col('key') % 3)
    return ranking.request_rate(requests).select('request_id', 'in_last_minute', 'blocked')


@query('min_gap', sql=with_sql(b.REQUESTS_SQL, body="""
SELECT request_id, gap_us, CASE WHEN gap_us IS NULL THEN 0 ELSE greatest(0, 5 - gap_us / 1e6) END AS wait_seconds
FROM (SELECT request_id, t - lag(t) OVER (PARTITION BY key % 3 ORDER BY t, request_id) AS gap_us
  FROM (SELECT request_id, key, epoch_us(date_trunc('minute', ts)) AS t FROM requests))"""))
def min_gap(spark, sf):
    # Times cut to the minute, so that many are equal.
    requests = b.requests(spark, sf).withColumn('key', F.col('key') % 3).withColumn(
        'ts', F.date_trunc('minute', 'ts').cast('timestamp_ntz'))
    return ranking.request_gap(requests).select('request_id', 'gap_us', 'wait_seconds')


@query('quota_24h', sql=with_sql(b.REQUESTS_SQL, LIMITS_SQL, body="""
SELECT request_id, model, nth, nth <= daily_limit AS accepted FROM (
  SELECT request_id, model, row_number() OVER (PARTITION BY model, CAST(ts AS DATE) ORDER BY ts, request_id) AS nth
  FROM requests) JOIN limits USING (model)"""))
def quota_24h(spark, sf):
    return ranking.daily_quota(b.requests(spark, sf), model_limits(spark)).select(
        'request_id', 'model', 'nth', 'accepted')


LATEST_SQL = """SELECT analysis_id, status, progress, file_count FROM scan_log
QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY ts DESC, event_id DESC) = 1"""


@query('latest_status', sql=with_sql(b.SCAN_LOG_SQL, body=LATEST_SQL))
def latest_status(spark, sf):
    return ranking.latest_status(b.scan_log(spark, sf)).select(
        'analysis_id', 'status', 'progress', 'file_count')


@query('lookup_scan', sql=with_sql(b.SCAN_LOG_SQL, f'states AS ({LATEST_SQL})', body="""
SELECT c_custkey AS analysis_id, status, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'processing'
  THEN 'processing' WHEN status = 'failed' THEN 'failed' ELSE 'results' END AS answer
FROM customer LEFT JOIN states ON c_custkey = analysis_id"""))
def lookup_scan(spark, sf):
    wanted = b.table(spark, sf, 'customer').select(F.col('c_custkey').alias('analysis_id'))
    return filters.lookup_scans(wanted, ranking.latest_status(b.scan_log(spark, sf))).select(
        'analysis_id', 'status', 'answer')


# ---- evaluation ----------------------------------------------------------------------------
# Truth rows lie four lines apart, so no prediction has two candidates: the earliest one wins.
MATCH_SQL = """matched AS (
  SELECT min(p.ord) AS ord, g.file AS truth_file, g.type, g.line AS truth_line
  FROM ground_truth g JOIN predictions p ON p.type = g.type AND abs(p.line - g.line) <= 1
    AND (ends_with(p.file, g.file) OR ends_with(g.file, p.file))
  GROUP BY g.file, g.type, g.line)"""


def _evaluated(spark, sf):
    """Predictions by base name, truth numbered by a hash-free key: file, type, line packed."""
    preds = b.predictions(spark, sf).withColumn('file', F.substring_index('file', '/', -1))
    truth = b.ground_truth(spark, sf).withColumn('ord', F.concat_ws(
        '|', 'file', 'type', F.lpad(F.col('line').cast('string'), 6, '0')))
    return preds, truth


@query('match_ground_truth', sql=with_sql(b.TRUTH_SQL, MATCH_SQL, body="""
SELECT ord, truth_file, type, truth_line FROM matched"""))
def match_ground_truth(spark, sf):
    preds, truth = _evaluated(spark, sf)
    pairs = evaluate.match(preds, truth)
    parts = F.split('truth_ord', r'\|')
    return pairs.select('ord', parts[0].alias('truth_file'), parts[1].alias('type'),
                        parts[2].cast('bigint').alias('truth_line'))


@query('unmatched_predictions', sql=with_sql(b.TRUTH_SQL, body="""
SELECT ord, file, type, line FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM ground_truth g
  WHERE p.type = g.type AND abs(p.line - g.line) <= 1 AND (ends_with(p.file, g.file) OR ends_with(g.file, p.file)))"""))
def unmatched_predictions(spark, sf):
    return evaluate.unmatched(*_evaluated(spark, sf)).select('ord', 'file', 'type', 'line')


@query('eval_prf1', sql=with_sql(b.TRUTH_SQL, MATCH_SQL, """counts AS (SELECT (SELECT count(*) FROM matched) AS tp,
  (SELECT count(*) FROM predictions) - (SELECT count(*) FROM matched) AS fp,
  (SELECT count(*) FROM ground_truth) - (SELECT count(*) FROM matched) AS fn),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM counts)""", body="""
SELECT tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0
  THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates"""))
def eval_prf1(spark, sf):
    preds, truth = _evaluated(spark, sf)
    return evaluate.metrics(preds, truth, evaluate.match(preds, truth))
