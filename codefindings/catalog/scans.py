"""Queries: pattern scan, code structure and import graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefindings import bindings as b
from codefindings.bindings import quoted, with_sql
from codefindings.catalog.basics import COMPLEXITY_SQL, STRIP_SQL
from codefindings.catalog.registry import query
from codefindings.dims.rules import enabled_rules, rules_of
from codefindings.operators import pysource, scan, structure

COLUMNS = ['path', 'rule_id', 'line_number', 'vulnerability_type', 'severity', 'description',
           'code_snippet', 'fix_suggestion', 'confidence', 'detection_method']


def rules_sql(rules) -> str:
    rows = ',\n'.join(
        f"({r.rule_id}, {quoted(r.check)}, {quoted(('(?i)' if r.ignore_case else '') + r.pattern)}, "
        f"{quoted(r.language) if r.language else 'NULL'}, {quoted(r.vulnerability_type)}, "
        f"{quoted(r.severity)}, {quoted(r.description)}, {quoted(r.fix_suggestion)}, "
        f"CAST({r.confidence} AS DOUBLE))" for r in rules)
    return ('rules(rule_id, check_name, pattern, language, vulnerability_type, severity, description, '
            f'fix_suggestion, confidence) AS (VALUES {rows})')


# Gaps and matches alternate, so the text before match i is gaps[1..i] plus matches[1..i-1].
FOUND_SQL = """pieces AS (
  SELECT repo, path, content, r.*, regexp_extract_all(content, pattern) AS m,
    string_split_regex(content, pattern) AS g
  FROM code_files f JOIN rules r ON (r.language IS NULL OR r.language = lower(f.language))
    AND regexp_matches(content, pattern)),
placed AS (
  SELECT *, 1 + length(before) - length(replace(before, chr(10), '')) AS line_number
  FROM (SELECT * EXCLUDE (m, g), array_to_string(list_concat(g[1:i], m[1:i-1]), '') AS before
        FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM pieces))),
found AS (SELECT repo, path, rule_id, check_name, line_number, vulnerability_type, severity, description,
  """ + STRIP_SQL.format('string_split(content, chr(10))[line_number]') + """ AS code_snippet,
  fix_suggestion, confidence, 'static_pattern' AS detection_method FROM placed)"""


def scan_sql(rules, body='SELECT ' + ', '.join(COLUMNS) + ' FROM found') -> str:
    return with_sql(b.CODE_SQL, rules_sql(rules), FOUND_SQL, body=body)


def _register(name, check):
    rules = rules_of(check)

    @query(name, sql=scan_sql(rules))
    def run(spark, sf):
        return scan.findings(b.code_files(spark, sf), rules).select(*COLUMNS)
    return run


for _name, _check in [('scan_secrets', 'secrets'), ('scan_passwords', 'passwords'),
                      ('scan_dangerous_calls', 'dangerous_calls'),
                      ('scan_sql_injection', 'sql_injection'), ('scan_xss', 'xss'),
                      ('scan_weak_crypto', 'weak_crypto'), ('scan_deserialization', 'deserialization'),
                      ('scan_path_traversal', 'path_traversal'),
                      ('scan_command_injection', 'command_injection'),
                      ('scan_db_settings', 'db_settings')]:
    _register(_name, _check)


@query('scan_all', sql=scan_sql(enabled_rules(), """
SELECT path, rule_id, line_number, vulnerability_type, severity, code_snippet, confidence,
  bool_or(severity = 'CRITICAL') OVER (PARTITION BY path) AS critical_issues FROM found"""))
def scan_all(spark, sf):
    return scan.findings(b.code_files(spark, sf)).select(
        'path', 'rule_id', 'line_number', 'vulnerability_type', 'severity', 'code_snippet',
        'confidence', 'critical_issues')


@query('union_findings', sql=scan_sql(enabled_rules(), """
SELECT check_name, path, line_number, vulnerability_type FROM found
UNION ALL SELECT 'model', path, line_number, vulnerability_type FROM
  (SELECT path, 1 AS line_number, 'CSRF' AS vulnerability_type FROM code_files)"""))
def union_findings(spark, sf):
    files = b.code_files(spark, sf)
    replies = files.select(F.lit('model').alias('check_name'), 'path', F.lit(1).cast('bigint').alias('line_number'),
                           F.lit('CSRF').alias('vulnerability_type'))
    return scan.findings(files).select('check_name', 'path', 'line_number',
                                       'vulnerability_type').unionByName(replies)


# ---- structure -----------------------------------------------------------------------------
_PY = r"'(?m)^(?:from\s+([\w\.]+)\s+import|import\s+([\w\.]+))'"
_JS1 = r"'import\s+(?:[^''\"]+from\s+)?[''\"]([^''\"]+)[''\"]'"
_JS2 = r"'require\(\s*[''\"]([^''\"]+)[''\"]\s*\)'"
PY_SQL = f"""list_sort(list_distinct(list_transform(list_filter(list_concat(
  regexp_extract_all(content, {_PY}, 1), regexp_extract_all(content, {_PY}, 2)), lambda x: x <> ''),
  lambda x: split_part(x, '.', 1))))"""
JS_SQL = f"""list_sort(list_distinct(list_concat(regexp_extract_all(content, {_JS1}, 1),
  regexp_extract_all(content, {_JS2}, 1))))"""
EDGES_SQL = f"""imports AS (SELECT repo, path, language, CASE WHEN language = 'python' THEN {PY_SQL}
  WHEN language IN ('javascript', 'typescript') THEN {JS_SQL} ELSE [] END AS modules FROM code_files),
edges AS (SELECT repo, path, unnest(modules) AS module FROM imports)"""


@query('py_imports', sql=with_sql(b.CODE_SQL, EDGES_SQL, body="""
SELECT path, array_to_string(modules, ',') AS modules FROM imports WHERE language = 'python'"""))
def py_imports(spark, sf):
    return b.code_files(spark, sf).filter("language = 'python'").select(
        'path', F.array_join(structure.python_imports(F.col('content')), ',').alias('modules'))


@query('js_imports', sql=with_sql(b.CODE_SQL, EDGES_SQL, body="""
SELECT path, array_to_string(modules, ',') AS modules FROM imports
WHERE language IN ('javascript', 'typescript')"""))
def js_imports(spark, sf):
    return b.code_files(spark, sf).filter("language IN ('javascript', 'typescript')").select(
        'path', F.array_join(structure.js_imports(F.col('content')), ',').alias('modules'))


@query('import_edges', sql=with_sql(b.CODE_SQL, EDGES_SQL, body="""
SELECT imports.path, module FROM imports LEFT JOIN edges USING (path)"""))
def import_edges(spark, sf):
    return structure.import_edges(b.code_files(spark, sf), outer=True).select('path', 'module')


@query('import_fanin', sql=with_sql(b.CODE_SQL, EDGES_SQL, body="""
SELECT 'module' AS kind, module AS name, count(DISTINCT path) AS degree FROM edges GROUP BY module
UNION ALL SELECT 'file', path, count(*) FROM edges GROUP BY path"""))
def import_fanin(spark, sf):
    edges = structure.import_edges(b.code_files(spark, sf))
    return structure.degrees(edges)


@query('distinct_imports', sql=with_sql(b.CODE_SQL, EDGES_SQL, body="""
SELECT DISTINCT repo, module FROM edges"""))
def distinct_imports(spark, sf):
    edges = structure.import_edges(b.code_files(spark, sf), keep=('repo', 'path'))
    return edges.select('repo', 'module').distinct()


def capture_sql(pattern, groups, where, select) -> str:
    """Matches of one pattern with their start line; group columns g1 … gN."""
    q = quoted(pattern)
    cols = ', '.join(f'regexp_extract_all(content, {q}, {g})[i] AS g{g}' for g in range(1, groups + 1))
    return with_sql(b.CODE_SQL, f"""cut AS (SELECT path, content, regexp_extract_all(content, {q}) AS m,
    string_split_regex(content, {q}) AS g FROM code_files WHERE {where} AND regexp_matches(content, {q})),
each AS (SELECT path, content, m, g, unnest(generate_series(1, len(m))) AS i FROM cut),
captured AS (SELECT path, i AS ord, {cols}, CAST(1 + len(regexp_extract_all(array_to_string(
    list_concat(g[1:i], m[1:i-1]), ''), chr(10))) AS INT) AS line_start FROM each)""", body=select)


_JSF = structure.JS_FUNCTION
_JS_FILES = "language IN ('javascript', 'typescript')"


@query('js_functions', sql=capture_sql(_JSF, 3, _JS_FILES, """
SELECT path, coalesce(nullif(g1, ''), nullif(g2, ''), g3) AS name, line_start FROM captured"""))
def js_functions(spark, sf):
    return structure.js_functions(b.code_files(spark, sf).filter(_JS_FILES)).select(
        'path', 'name', 'line_start')


@query('js_classes', sql=capture_sql(structure.JS_CLASS, 1, _JS_FILES, """
SELECT path, g1 AS name, line_start FROM captured"""))
def js_classes(spark, sf):
    return structure.js_classes(b.code_files(spark, sf).filter(_JS_FILES)).select(
        'path', 'name', 'line_start')


@query('js_module_refs', sql=capture_sql(structure.JS_MODULE, 2, _JS_FILES, """
SELECT path, coalesce(nullif(g1, ''), g2) AS module, CASE WHEN g1 <> '' THEN 'import' ELSE 'require' END AS kind
FROM captured"""))
def js_module_refs(spark, sf):
    return structure.js_module_refs(b.code_files(spark, sf).filter(_JS_FILES)).select(
        'path', 'module', 'kind')


def _n(pattern):
    return f'CAST(len(regexp_extract_all(content, {quoted(pattern)})) AS BIGINT)'


def _by_ext(js, py):
    return (f"CASE WHEN ends_with(path, '.js') OR ends_with(path, '.jsx') THEN {js} "
            f"WHEN ends_with(path, '.py') THEN {py} ELSE 0 END")


@query('structure_summary', sql=with_sql(b.CODE_SQL, body=f"""
SELECT path, {_by_ext(_n(_JSF), _n('(?m)' + structure.PY_FUNCTION))} AS functions,
  {_by_ext(_n(structure.JS_CLASS), _n('(?m)' + structure.PY_CLASS))} AS classes,
  {_by_ext(_n(structure.JS_MODULE), _n('(?m)' + structure.PY_IMPORT))} AS imports,
  {COMPLEXITY_SQL} AS complexity FROM code_files"""))
def structure_summary(spark, sf):
    return structure.summary(b.code_files(spark, sf)).select(
        'path', 'functions', 'classes', 'imports', 'complexity')


@query('py_symbols', sql=' UNION ALL '.join(
    'SELECT * FROM (' + capture_sql('(?m)' + pattern, groups, "language = 'python'", f"""
SELECT path, '{kind}' AS kind, {name} AS name, {detail} AS detail, line_start FROM captured""") + ')'
    for kind, pattern, groups, name, detail in [
        ('function', structure.PY_FUNCTION, 2, 'g2', "coalesce(g1, '') <> ''"),
        ('class', structure.PY_CLASS, 2, 'g1', "coalesce(g2, '') <> ''"),
        ('import', structure.PY_IMPORT, 2, "coalesce(nullif(g1, ''), g2)", "coalesce(g1, '') <> ''")]))
def py_symbols(spark, sf):
    return structure.py_symbols(b.code_files(spark, sf).filter("language = 'python'")).select(
        'path', 'kind', 'name', 'detail', 'line_start')


@query('py_structure')
def py_structure(spark, sf):
    found = pysource.structure(b.code_files(spark, sf).filter("language = 'python'"))
    return found.select('path', 'ord', 'kind', 'name', 'line_start', 'line_end', 'parent', 'in_class', 'is_async',
                        F.array_join('args', ',').alias('args'), F.array_join('bases', ',').alias('bases'), 'alias', 'imported')
