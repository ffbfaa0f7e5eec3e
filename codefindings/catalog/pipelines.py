"""Queries: dependencies, snapshots, model replies, reports, whole scans, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefindings import bindings as b
from codefindings.bindings import quoted, with_sql
from codefindings.catalog import basics, findings as fq, scans as sq
from codefindings.catalog.registry import query
from codefindings.dims import names
from codefindings.dims.rules import enabled_rules
from codefindings.operators import aggregate, dependencies, merge, replies, snapshots
from codefindings.plans import repo_scan as scans_plan, report
from codefindings.sources import sinks
from codefindings.sources.scratch import new_folder
from codefindings.streaming import jobs

# ---- dependencies --------------------------------------------------------------------------
_REQ = r"'^([A-Za-z0-9_.\-]+)\s*(==|>=|<=|~=|!=)?\s*([A-Za-z0-9_.\-]+)?'"
_LINE = basics.STRIP_SQL.format('unnest(string_split(content, chr(10)))')


def _deps(name, ecosystem, body):
    return f"""{name} AS (SELECT repo, manifest, '{ecosystem}' AS ecosystem, name,
  coalesce(nullif(version, ''), '*') AS version FROM ({body}))"""


DEPS_SQL = b.MANIFESTS_SQL + ',\n' + ',\n'.join([
    _deps('pypi', 'PyPI', f"""SELECT repo, manifest, regexp_extract(line, {_REQ}, 1) AS name,
  regexp_extract(line, {_REQ}, 3) AS version FROM (SELECT repo, manifest, {_LINE} AS line FROM manifests
  WHERE filename = 'requirements.txt') WHERE line <> '' AND line[1] <> '#' AND regexp_matches(line, {_REQ})"""),
    _deps('npm', 'npm', """SELECT repo, manifest, e.key AS name, e.value AS version FROM (
  SELECT repo, manifest, unnest(list_concat(list_concat(
    coalesce(map_entries(CAST(json_extract(content, '$.dependencies') AS MAP(VARCHAR, VARCHAR))), []),
    coalesce(map_entries(CAST(json_extract(content, '$.devDependencies') AS MAP(VARCHAR, VARCHAR))), [])),
    coalesce(map_entries(CAST(json_extract(content, '$.peerDependencies') AS MAP(VARCHAR, VARCHAR))), []))) AS e
  FROM (SELECT repo, manifest, CASE WHEN json_valid(content) THEN content ELSE '{}' END AS content
        FROM manifests WHERE filename = 'package.json'))"""),
    _deps('cargo', 'crates.io', r"""SELECT repo, manifest, regexp_extract(line, '^([\w-]+)\s*=', 1) AS name,
  regexp_extract(line, '(?:^[\w-]+\s*=\s*|version\s*=\s*)"([^"]*)"', 1) AS version FROM (
  SELECT repo, manifest, unnest(string_split(regexp_extract(content, '(?s)\[dependencies\]\n(.*?)(?:\n\[|$)', 1), chr(10))) AS line
  FROM manifests WHERE filename = 'Cargo.toml') WHERE regexp_matches(line, '^[\w-]+\s*=')"""),
    _deps('gomod', 'Go', r"""SELECT repo, manifest, words[1] AS name, words[2] AS version FROM (
  SELECT repo, manifest, regexp_split_to_array(trim(replace(line, 'require ', '')), '\s+') AS words FROM (
    SELECT repo, manifest, """ + _LINE + r""" AS line FROM manifests WHERE filename = 'go.mod')
  WHERE line <> '' AND NOT starts_with(line, '//') AND NOT starts_with(line, 'module ')) WHERE len(words) >= 2"""),
    """deps AS (SELECT * FROM pypi UNION ALL SELECT * FROM npm UNION ALL SELECT * FROM cargo
  UNION ALL SELECT * FROM gomod)"""])


def _register_deps(name, table, parse, filename):
    @query(name, sql=with_sql(DEPS_SQL, body=f'SELECT * FROM {table}'))
    def run(spark, sf):
        return parse(b.manifests(spark, sf).filter(F.col('filename') == filename))


_register_deps('deps_requirements', 'pypi', dependencies.requirements, 'requirements.txt')
_register_deps('deps_package_json', 'npm', dependencies.package_json, 'package.json')
_register_deps('deps_cargo', 'cargo', dependencies.cargo_toml, 'Cargo.toml')
_register_deps('deps_go_mod', 'gomod', dependencies.go_mod, 'go.mod')


@query('deps_all', sql=with_sql(DEPS_SQL, body='SELECT * FROM deps'))
def deps_all(spark, sf):
    return dependencies.all_dependencies(b.manifests(spark, sf))


@query('union_manifests', sql=with_sql(DEPS_SQL, body="""
SELECT repo, ecosystem, name, version, count(*) AS n FROM deps GROUP BY ALL"""))
def union_manifests(spark, sf):
    return dependencies.all_dependencies(b.manifests(spark, sf)).groupBy(
        'repo', 'ecosystem', 'name', 'version').agg(F.count(F.lit(1)).alias('n'))


HITS_SQL = DEPS_SQL + ',\n' + b.ADVISORIES_SQL + r""",
scored AS (SELECT *, list_filter(list_transform(list_filter(severity, lambda s: s.type IN ('CVSS_V3', 'CVSS_V2')),
  lambda s: try_cast(split_part(s.score, '/', 1) AS DOUBLE)), lambda x: x IS NOT NULL)[1] AS score FROM advisories),
dep_hits AS (SELECT d.*, id, summary, CASE WHEN score IS NULL OR isnan(score) THEN 'LOW' WHEN score >= 9 THEN 'CRITICAL'
  WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM deps d JOIN scored s ON d.ecosystem = s.ecosystem AND d.name = s.name
  WHERE d.version = '*' OR list_contains(s.versions, d.version)),
dep_risk AS (SELECT repo, CAST(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2
  ELSE 1 END) AS BIGINT) AS dependency_risk FROM dep_hits GROUP BY repo)"""


@query('deps_advisories', sql=with_sql(HITS_SQL, body="""
SELECT repo, manifest, ecosystem, name, version, id, summary, severity FROM dep_hits"""))
def deps_advisories(spark, sf):
    return dependencies.advisories_for(dependencies.all_dependencies(b.manifests(spark, sf)),
                                       b.advisories(spark, sf))


@query('deps_advisory_ranges', sql=with_sql(DEPS_SQL, b.ADVISORIES_SQL, b.RANGED_SQL, body=r"""
SELECT d.repo, d.manifest, d.ecosystem, d.name, d.version, a.id, a.summary FROM deps d JOIN ranged a USING (ecosystem, name)
WHERE d.version = '*' OR (a.k % 6 = 0 AND d.version = '1.45') OR EXISTS (SELECT 1 FROM spans s WHERE s.id = a.id
  AND try_cast(regexp_extract(d.version, '^v?1\.(\d+)$', 1) AS BIGINT) BETWEEN s.low AND s.high - 1)"""))
def deps_advisory_ranges(spark, sf):
    found = dependencies.advisories_for(dependencies.all_dependencies(b.manifests(spark, sf)), b.ranged_advisories(spark, sf))
    return found.select('repo', 'manifest', 'ecosystem', 'name', 'version', 'id', 'summary')


@query('deps_risk', sql=with_sql(HITS_SQL, body='SELECT * FROM dep_risk'))
def deps_risk(spark, sf):
    return fq.dependency_risk(spark, sf)


@query('score_repo', sql=with_sql(HITS_SQL, b.FINDINGS_SQL, body=f"""
SELECT repo, coalesce(file_score, 0) AS file_score, coalesce(dependency_risk, 0) AS dependency_risk,
  coalesce(file_score, 0) + coalesce(dependency_risk, 0) AS repo_score
FROM (SELECT repo, CAST(sum({fq.RISK_SQL}) AS BIGINT) AS file_score FROM (SELECT repo, severity FROM findings
  UNION ALL SELECT 'found', severity FROM findings WHERE ord % 101 = 0) GROUP BY repo)
FULL JOIN (SELECT * FROM dep_risk UNION ALL SELECT 'needed', dependency_risk FROM dep_risk WHERE repo = 'repo2') USING (repo)"""))
def score_repo(spark, sf):
    # One more repository with findings only, and one with dependencies only.
    found, needs = b.findings(spark, sf), fq.dependency_risk(spark, sf)
    found = found.unionByName(found.filter('ord % 101 = 0').withColumn('repo', F.lit('found')))
    needs = needs.unionByName(needs.filter("repo = 'repo2'").withColumn('repo', F.lit('needed')))
    return aggregate.repo_scores(found, needs)


# ---- snapshots -----------------------------------------------------------------------------
_DIFF = b.SNAPSHOT_SQL + """,
diffs AS (SELECT repo, path, CASE WHEN b.content IS NULL THEN 'added' WHEN h.content IS NULL THEN 'deleted' ELSE 'changed' END AS change
  FROM base b FULL JOIN head h USING (repo, path) WHERE b.content IS DISTINCT FROM h.content)"""


@query('snapshot_diff', sql=with_sql(_DIFF, body='SELECT * FROM diffs'))
def snapshot_diff(spark, sf):
    return snapshots.diff(*b.snapshots(spark, sf))


@query('join_changed_files', sql=with_sql(_DIFF, body="""
SELECT repo, path FROM head WHERE (repo, path) IN (SELECT (repo, path) FROM diffs)
  OR repo NOT IN (SELECT repo FROM diffs)"""))
def join_changed_files(spark, sf):
    base, head = b.snapshots(spark, sf)
    return snapshots.only_changed(head, snapshots.diff(base, head)).select('repo', 'path')


# ---- model replies -------------------------------------------------------------------------
_J = r"regexp_extract(reply, '(?s)\{.*\}', 0)"
PARSED_SQL = b.REPLIES_SQL + f""",
parsed AS (SELECT *, {_J} AS j, CASE WHEN reply IS NULL THEN 'no_reply' WHEN {_J} = '' THEN 'no_json'
  WHEN NOT json_valid({_J}) THEN 'bad_json' END AS error FROM ai_responses),
good AS (SELECT *, coalesce(json_array_length(j, '$.vulnerabilities'), 0) AS n_found FROM parsed WHERE error IS NULL)"""


@query('fn_extract_json', sql=with_sql(b.REPLIES_SQL, body=f"""
SELECT reply_id, length({_J}) AS n_chars, md5({_J}) AS json_md5 FROM ai_responses"""))
def fn_extract_json(spark, sf):
    text = replies.json_text(F.col('reply'))
    return b.ai_responses(spark, sf).select('reply_id', F.length(text).cast('bigint').alias('n_chars'),
                                            F.md5(text).alias('json_md5'))


@query('ai_parse_reply', sql=with_sql(PARSED_SQL, body="""
SELECT reply_id, CAST(n_found AS BIGINT) AS n_found, CASE WHEN json_extract(j, '$.summary') IS NULL THEN CAST(n_found AS BIGINT)
    ELSE CAST(json_extract(j, '$.summary.total_vulnerabilities') AS BIGINT) END AS total_vulnerabilities,
  coalesce(CAST(json_extract(j, '$.summary.high_count') AS BIGINT), 0) AS high_count,
  coalesce(CAST(json_extract(j, '$.metadata.tokens_used') AS BIGINT),
           CAST(json_extract(j, '$.metadata.gemini_tokens_used') AS BIGINT), 0) AS tokens_used,
  CAST(json_extract(j, '$.vulnerabilities[0].line_number') AS BIGINT) AS first_line FROM good"""))
def ai_parse_reply(spark, sf):
    usable = replies.good(replies.parse(b.ai_responses(spark, sf)))
    return usable.select('reply_id', F.size('vulnerabilities').cast('bigint').alias('n_found'),
                         'total_vulnerabilities', 'high_count', 'tokens_used',
                         F.get('vulnerabilities', F.lit(0))['line_number'].alias('first_line'))


@query('ai_error_rows', sql=with_sql(PARSED_SQL, body='SELECT reply_id, error, CASE error ' + ' '.join(
    f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in replies.MESSAGES.items()) + """ END AS message,
  reply, left(coalesce(reply, ''), 500) AS raw_response, CAST(0 AS BIGINT) AS total_vulnerabilities FROM parsed WHERE error IS NOT NULL"""))
def ai_error_rows(spark, sf):
    return replies.errors(replies.parse(b.ai_responses(spark, sf))).select(
        'reply_id', 'error', 'message', 'reply', 'raw_response', 'total_vulnerabilities')


@query('agg_tokens', sql=with_sql(PARSED_SQL, body="""
SELECT model_used, filename, count(*) AS replies, CAST(sum(code_length) AS BIGINT) AS code_length,
  CAST(sum(coalesce(CAST(json_extract(j, '$.metadata.tokens_used') AS BIGINT),
    CAST(json_extract(j, '$.metadata.gemini_tokens_used') AS BIGINT), 0)) AS BIGINT) AS tokens
FROM good GROUP BY model_used, filename"""))
def agg_tokens(spark, sf):
    return replies.token_totals(replies.good(replies.parse(b.ai_responses(spark, sf))),
                                'model_used', 'filename')


_STORED = ("'{\"test' || event_id || '\": {\"metadata\": {\"filename\": \"' || CASE WHEN event_id % 3 = 0 THEN '' "
           "ELSE 'dir/f' || event_id || '.py' END || '\"}, \"file\": \"' || CASE WHEN event_id % 2 = 0 THEN 'x/g.py' ELSE '' END "
           "|| '\", \"vulnerabilities\": [{\"line_number\": ' || (event_id % 4) || ', \"line\": ' || (event_id % 3) || "
           "', \"vulnerability_type\": \" sql_injection \"}, {\"type\": \"xss\"}]}, \"empty\": {\"vulnerabilities\": []}}'")
_STORED_SPARK = _STORED.replace('(event_id', 'CAST((event_id').replace(" % 4)", " % 4) AS STRING)").replace(
    " % 3) ||", " % 3) AS STRING) ||").replace("|| event_id ||", "|| CAST(event_id AS STRING) ||")


@query('src_results_json', sql=f"""WITH stored AS (SELECT event_id, {_STORED} AS doc FROM events),
tests AS (SELECT event_id, key, json_extract(doc, '$."' || key || '"') AS a FROM (
  SELECT event_id, doc, unnest(json_keys(doc)) AS key FROM stored)),
items AS (SELECT event_id, key, a, unnest(generate_series(0, CAST(json_array_length(a, '$.vulnerabilities') AS BIGINT) - 1)) AS ord FROM tests)
SELECT event_id, split_part(f, '/', -1) AS file, upper(trim(coalesce(nullif(json_extract_string(v, '$.vulnerability_type'), ''),
    json_extract_string(v, '$.type'), ''))) AS type, ord,
  coalesce(nullif(CAST(json_extract(v, '$.line_number') AS BIGINT), 0), nullif(CAST(json_extract(v, '$.line') AS BIGINT), 0), -1) AS line
FROM (SELECT event_id, ord, json_extract(a, '$.vulnerabilities[' || ord || ']') AS v,
  coalesce(nullif(json_extract_string(a, '$.metadata.filename'), ''), nullif(json_extract_string(a, '$.file'), ''), key) AS f FROM items)""")
def src_results_json(spark, sf):
    stored = b.table(spark, sf, 'events').select('event_id', F.expr(_STORED_SPARK).alias('json'))
    return replies.stored_predictions(stored, ['event_id']).select('event_id', 'file', 'type', 'line', F.col('ord').cast('bigint').alias('ord'))


# ---- reports -------------------------------------------------------------------------------
@query('report_overview', sql=with_sql(b.FINDINGS_SQL, b.ANALYZED_SQL, body=f"""
SELECT *, {fq.REPORT_SCORE_SQL} AS risk_score, CASE WHEN {fq.REPORT_SCORE_SQL} >= 80 THEN 'CRITICAL' WHEN {fq.REPORT_SCORE_SQL} >= 60 THEN 'HIGH'
  WHEN {fq.REPORT_SCORE_SQL} >= 30 THEN 'MEDIUM' WHEN {fq.REPORT_SCORE_SQL} >= 10 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level
FROM (SELECT repo, {fq.COUNTS_SQL} FROM findings GROUP BY repo)
JOIN (SELECT repo, count(DISTINCT path) AS files_analyzed FROM analyzed_files GROUP BY repo) USING (repo)"""))
def report_overview(spark, sf):
    return report.overview(b.analyzed_files(spark, sf), b.findings(spark, sf)).drop('colour', 'level_text')


@query('report_details', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT repo, path, severity, vulnerability_type, line_number, description, code_snippet, fix_suggestion,
  CAST(round(confidence * 100) AS BIGINT) AS confidence_percent, row_number() OVER (PARTITION BY repo, path
  ORDER BY {fq.REPORT_RANK_SQL}, line_number, ord) AS position FROM findings"""))
def report_details(spark, sf):
    return report.details(b.findings(spark, sf))


@query('dashboard_cards', sql=with_sql(b.FINDINGS_SQL, b.ANALYZED_SQL, """stored AS (SELECT 'repo' || s_suppkey AS repo,
  CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1000 + s_suppkey END AS t, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS c FROM supplier)""", body="""
SELECT repo, files, CAST(1 AS BIGINT) AS languages, coalesce(nullif(t, 0), n, 0) AS issues, coalesce(nullif(c, 0), k, 0) AS critical
FROM (SELECT repo, count(DISTINCT path) AS files FROM analyzed_files GROUP BY repo)
LEFT JOIN (SELECT repo, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS k FROM findings GROUP BY repo) USING (repo)
LEFT JOIN stored USING (repo)"""))
def dashboard_cards(spark, sf):
    k = F.col('s_suppkey')
    stored = b.table(spark, sf, 'supplier').select(
        F.concat(F.lit('repo'), k.cast('string')).alias('repo'),
        F.when(k % 2 == 0, 0).otherwise(k + 1000).alias('total_vulnerabilities'),
        F.when(k % 3 != 0, k).alias('critical_count'))
    return report.dashboard(b.analyzed_files(spark, sf), b.findings(spark, sf), stored)


# ---- whole scans ---------------------------------------------------------------------------
def model_answers(spark, sf):
    """Model findings for the code files: two per file, one on a line the rules may cover too."""
    lines = F.explode(F.array(F.lit(2), F.lit(3))).alias('line_number')
    return b.code_files(spark, sf).select(
        'repo', 'path', lines, F.lit('WEAK_CRYPTO').alias('vulnerability_type'), F.lit('MEDIUM').alias('severity'),
        (F.col('doc_id') % 4 == 3).alias('failed')).withColumn('ord', F.col('line_number').cast('bigint'))


def _critical(found):
    return f"SELECT (repo, path) FROM {found} WHERE severity = 'CRITICAL'"


_STAGED = sq.FOUND_SQL + f""",
answers AS (SELECT repo, path, doc_id % 4 = 3 AS failed, unnest([2, 3]) AS line_number FROM code_files),
usable AS (SELECT repo, path, line_number, 'WEAK_CRYPTO' AS vulnerability_type FROM answers WHERE NOT failed AND (repo, path) NOT IN ({_critical('found')})),
merged AS (SELECT repo, path, line_number, vulnerability_type, severity, 'static_pattern' AS method FROM found UNION ALL
  SELECT repo, path, line_number, vulnerability_type, 'MEDIUM', 'model' FROM usable u WHERE NOT EXISTS (SELECT 1 FROM found f
    WHERE f.repo = u.repo AND f.path = u.path AND f.line_number = u.line_number AND f.vulnerability_type = u.vulnerability_type))"""


@query('staged_scan', sql=with_sql(b.CODE_SQL, sq.rules_sql(enabled_rules()), _STAGED, basics.PARTED_SQL.replace(
    'SELECT path, language,', 'SELECT repo, path, language,'), body=f"""
SELECT repo, path, NULL AS part, line_number, vulnerability_type, severity, method, 'finding' AS kind FROM merged
UNION ALL SELECT repo, path, part, NULL, NULL, NULL, md5({basics.PROMPT_SQL}), 'prompt' FROM parted WHERE (repo, path) NOT IN ({_critical('found')})
UNION ALL SELECT repo, path, NULL, NULL, NULL, NULL, NULL, 'skipped' FROM code_files WHERE (repo, path) IN ({_critical('found')})"""))
def staged_scan(spark, sf):
    dim = spark.createDataFrame(basics.PROMPTS, 'language string, instruction string')
    done = scans_plan.staged(b.code_files(spark, sf), dim, model_answers(spark, sf))
    merged = done.findings.select('repo', 'path', F.lit(None).cast('bigint').alias('part'), 'line_number', 'vulnerability_type', 'severity',
                                  F.coalesce('detection_method', F.lit('model')).alias('method'),
                                  F.lit('finding').alias('kind'))
    asked = done.prompts.select('repo', 'path', F.col('part').cast('bigint').alias('part'),
                                F.md5('prompt').alias('method'), F.lit('prompt').alias('kind'))
    skipped = done.skipped.select('repo', 'path', F.lit('skipped').alias('kind'))
    return (merged.unionByName(asked, allowMissingColumns=True)
            .unionByName(skipped, allowMissingColumns=True))


def scan_input(spark, sf):
    """Code files without their language, as a source tree would give them."""
    return b.code_files(spark, sf).drop('language')


_LANG = basics._map(basics.languages.REPO_EXTENSIONS, "regexp_extract(path, '\\.[a-z]+$')")


_NEEDED = "SELECT 'src' || substr(repo, 5) AS repo, dependency_risk FROM dep_risk UNION ALL SELECT 'needed', dependency_risk FROM dep_risk WHERE repo = 'repo2'"


def _repo_scan_sql(code='all_code'):
    return with_sql(HITS_SQL, b.CODE_SQL.replace('code_files AS', 'every_code AS'), f"all_code AS (SELECT * FROM every_code {'' if code == 'all_code' else code})", """
files AS (SELECT path, content FROM all_code)""", basics.RATIOS_SQL, f"""
code_files AS (SELECT all_code.* REPLACE (coalesce({_LANG}, 'unknown') AS language) FROM all_code JOIN ratios USING (path)
  WHERE ratio > 0.7 AND strlen(content) > 0)""",
                    sq.rules_sql(enabled_rules()), sq.FOUND_SQL, body=f"""
SELECT *, file_score + dependency_risk AS repo_score, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high >= 5 THEN 'HIGH'
    WHEN high >= 2 THEN 'MEDIUM' WHEN high = 1 AND medium >= 5 THEN 'MEDIUM' WHEN high = 1 THEN 'LOW' WHEN medium >= 10 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level
FROM (SELECT repo, coalesce(files_discovered, 0) AS files_discovered, coalesce(languages, '') AS languages,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['total', *fq.COUNTS, 'files_with_issues', 'file_score', 'dependency_risk'])}
  FROM (SELECT repo, count(*) AS files_discovered, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM code_files GROUP BY repo) t
  LEFT JOIN (SELECT repo, {fq.COUNTS_SQL}, count(DISTINCT path) AS files_with_issues, CAST(sum({fq.RISK_SQL}) AS BIGINT) AS file_score
        FROM found GROUP BY repo) c USING (repo)
  FULL JOIN ({_NEEDED}) d USING (repo))""")


def _needed(spark, sf):
    risk = fq.dependency_risk(spark, sf)
    return risk.withColumn('repo', F.concat(F.lit('src'), F.substring('repo', 5, 9))).unionByName(
        risk.filter("repo = 'repo2'").withColumn('repo', F.lit('needed')))


@query('repo_scan', sql=_repo_scan_sql())
def repo_scan(spark, sf):
    return scans_plan.scan_repository(scan_input(spark, sf), _needed(spark, sf))


@query('repo_scan_changed', sql=_repo_scan_sql("WHERE doc_id % 3 = 0 OR repo NOT IN (SELECT repo FROM every_code WHERE doc_id % 3 = 0 AND repo <> 'src1')"))
def repo_scan_changed(spark, sf):
    files = scan_input(spark, sf)
    changed = files.filter("doc_id % 3 = 0 AND repo <> 'src1'").select('repo', 'path')
    return scans_plan.scan_repository(files, _needed(spark, sf), changed)


# ---- sinks ---------------------------------------------------------------------------------
@query('sink_json', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT path, ord, line_number, severity, vulnerability_type, confidence FROM findings"""))
def sink_json(spark, sf):
    out = new_folder(spark, 'export')
    result = b.findings(spark, sf).select('path', 'ord', 'line_number', 'severity',
                                          'vulnerability_type', 'confidence')
    sinks.export_json(result, out)
    return spark.read.schema(result.schema).json(out)


@query('sink_history', sql=with_sql(b.HISTORY_SQL, body=fq.HISTORY20_SQL))
def sink_history(spark, sf):
    out = new_folder(spark, 'history')
    rows = b.history(spark, sf)
    for half in (rows.filter('ord % 2 = 0'), rows.filter('ord % 2 = 1')):
        sinks.append_history(half, out)
    return sinks.read_history(spark, out, ['repo_id']).select(
        'repo_id', 'ord', 'repo_score', 'critical', 'high', 'label')


_ALERT_ROWS = """SELECT ord, 'Security Alert: repo' || repo_id || ' — ' || critical || ' critical, ' || high || ' high' AS title,
  CASE WHEN critical > 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  CASE WHEN critical > 0 THEN '#dc3545' ELSE '#fd7e14' END AS colour FROM history WHERE critical > 0 OR high > 0"""


def summaries(spark, sf):
    return b.history(spark, sf).withColumn('repo', F.concat(F.lit('repo'), F.col('repo_id').cast('string')))


@query('sink_alerts', sql=with_sql(b.HISTORY_SQL, body=_ALERT_ROWS))
def sink_alerts(spark, sf):
    out = new_folder(spark, 'alerts')
    sinks.append_alerts(summaries(spark, sf), out, 1)
    return spark.read.parquet(f'{out}/batch=1').select('ord', 'title', 'severity', 'colour')


# ---- streams -------------------------------------------------------------------------------
def stream(spark, sf, name):
    """The table as a file stream. A table is one file or a folder of part files: a file stream takes both by a glob only."""
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f'{sf}/{{{name}}}.parquet')


def _run(spark, df, mode='append', sink=None):
    out, state = new_folder(spark, 'stream'), new_folder(spark, 'state')
    jobs.run_available(df, out if sink is None else sink(out), state, mode)
    return out


def stream_findings(spark, sf):
    return b.findings_of(stream(spark, sf, 'events')).withColumn('ts', jobs.as_instant('found_at'))


@query('stream_scan', sql=sq.scan_sql(enabled_rules(), """
SELECT path, rule_id, line_number, severity, code_snippet FROM found"""))
def stream_scan(spark, sf):
    found = jobs.scan_new_files(b.code_files_of(stream(spark, sf, 'documents')))
    out = _run(spark, found.select('path', 'rule_id', 'line_number', 'severity', 'code_snippet'))
    return spark.read.parquet(out)


@query('stream_severity_trend', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT strftime(date_trunc('day', found_at), '%Y-%m-%d') AS day, severity, count(*) AS n FROM findings
GROUP BY date_trunc('day', found_at), severity"""))
def stream_severity_trend(spark, sf):
    trend = jobs.severity_trend(stream_findings(spark, sf).select('ts', 'severity'))
    out = _run(spark, trend, 'update', jobs.append_versions)
    return jobs.newest_versions(spark, out, ['start', 'severity']).select(F.date_format('start', 'yyyy-MM-dd').alias('day'), 'severity', 'n')


@query('stream_rate', sql=with_sql(b.REQUESTS_SQL, body="""
SELECT key, w AS start_second, count(*) AS n, count(*) >= 12 AS breach FROM (
  SELECT key % 3 AS key, unnest(generate_series(CAST(floor(epoch_us(ts) / 1e7) AS BIGINT) * 10 - 50,
    CAST(floor(epoch_us(ts) / 1e7) AS BIGINT) * 10, 10)) AS w FROM requests) GROUP BY key, w"""))
def stream_rate(spark, sf):
    requests = stream(spark, sf, 'events').select((F.col('user_id') % 3).alias('key'),
                                                  jobs.as_instant('ts').alias('ts'))
    out = _run(spark, jobs.request_windows(requests), 'update', jobs.append_versions)
    return jobs.newest_versions(spark, out, ['start', 'key']).select('key', F.unix_seconds('start').alias('start_second'), 'n', 'breach')


@query('stream_dedupe', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT DISTINCT repo, path, line_number, vulnerability_type FROM findings"""))
def stream_dedupe(spark, sf):
    found = stream_findings(spark, sf).select(*merge.KEY, 'ts')
    out = _run(spark, found, 'append', lambda path: jobs.first_sightings(path, merge.KEY))
    return spark.read.parquet(out).select(*merge.KEY)


@query('stream_latest_status', sql=with_sql(b.SCAN_LOG_SQL, body=fq.LATEST_SQL))
def stream_latest_status(spark, sf):
    log = b.scan_log_of(stream(spark, sf, 'events'))
    state = jobs.latest_state(log, 'analysis_id', ['status', 'progress', 'file_count'], ['ts', 'event_id'])
    out = _run(spark, state, 'update', jobs.append_versions)
    return jobs.newest_versions(spark, out, ['analysis_id'])


@query('stream_history', sql=with_sql(b.HISTORY_SQL, body=fq.HISTORY20_SQL))
def stream_history(spark, sf):
    out = _run(spark, b.history_of(stream(spark, sf, 'events')), 'append', jobs.append_versions)
    return sinks.read_history(spark, out, ['repo_id']).select(
        'repo_id', 'ord', 'repo_score', 'critical', 'high', 'label')


@query('stream_alerts', sql=with_sql(b.HISTORY_SQL, body=f"""
SELECT scan_id, title, severity, colour FROM (SELECT ord % 1000 AS scan_id, a.* FROM ({_ALERT_ROWS}) a)
QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ord) = 1"""))
def stream_alerts(spark, sf):
    rows = (b.history_of(stream(spark, sf, 'events')).withColumn('scan_id', F.col('ord') % 1000)
            .withColumn('repo', F.concat(F.lit('repo'), F.col('repo_id').cast('string'))))
    out = _run(spark, rows, 'append', jobs.alert_sink)
    return spark.read.parquet(out).select('scan_id', 'title', 'severity', 'colour')
