"""Test-data views: source files, findings, logs and manifests derived from the given tables.

Every view is written twice from the same formula, as a Spark DataFrame and as a DuckDB common
table expression, so that queries and their SQL see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f'{sf}/{name}.parquet')


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return '[' + ', '.join(quoted(v) for v in values) + ']'


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast('int'))


# ---- files ---------------------------------------------------------------------------------
DIRS = ['src', 'node_modules', 'a/b', 'Vendor', 'docs', 'lib/.git/x', 'lib', 'logs']
EXTS = ['.py', '.js', '.java', '.php', '.c', '.cpp', '.min.js', '.png', '.R', '.cs', '.tar.gz', '',
        '.go', '.ts', '.txt', '.lock', '.log', '.pl', '.Rmd', '.h', '.svg', '.webp', '.woff2', '.XYZ',
        '.jsx', '.md', '.bak', '.hpp', '.bundle.css']
SPECIAL = ['Dockerfile', '.gitignore', 'package-lock.json', 'README', 'run_config', 'my_script',
           'unittests', '.env', '.eslintrc', '.hidden', 'favicon.txt', 'requirements.txt', 'go.mod',
           'Cargo.toml', 'package.json', '.env.local', 'CMakeLists.txt', 'archive.zip', '..x.y.',
           'a:zone.identifier']


def files(spark, sf) -> DataFrame:
    """repo, path, filename, size, content, doc_id: one file per document."""
    d = table(spark, sf, 'documents')
    k = F.col('doc_id')
    name = F.when(k % 3 == 0, pick(SPECIAL, F.floor(k / 3) % len(SPECIAL))).otherwise(
        F.concat(F.lit('f'), k.cast('string'), pick(EXTS, k % len(EXTS))))
    return d.select(
        F.col('source').alias('repo'),
        F.concat(pick(DIRS, F.floor(k / 2) % len(DIRS)), F.lit('/'), k.cast('string'), F.lit('/'),
                 name).alias('path'),
        name.alias('filename'), F.octet_length('text').cast('bigint').alias('size'),
        F.col('text').alias('content'), 'doc_id')


FILES_SQL = f"""files AS (
  SELECT repo, dir || '/' || doc_id || '/' || filename AS path, filename, size, content, doc_id
  FROM (SELECT source AS repo, doc_id, text AS content, CAST(strlen(text) AS BIGINT) AS size,
          {sql_list(DIRS)}[(doc_id // 2) % {len(DIRS)} + 1] AS dir,
          CASE WHEN doc_id % 3 = 0 THEN {sql_list(SPECIAL)}[(doc_id // 3) % {len(SPECIAL)} + 1]
               ELSE 'f' || doc_id || {sql_list(EXTS)}[doc_id % {len(EXTS)} + 1] END AS filename
        FROM documents))"""

# ---- code files ----------------------------------------------------------------------------
KEY20 = 'Ab1' * 7
SNIPPETS = [
    ('py', f'api_key = "{KEY20}"\npassword = \'hunter2\''),
    ('py', f'SECRET-KEY: "{KEY20}"  \n  access_token="{KEY20}"; auth-token = \'{KEY20}\''),
    ('js', f'const k = "sk-{KEY20}"; const p = "pk_{KEY20}"; x="{KEY20}{KEY20}"; y="{KEY20}{KEY20}"'),
    ('py', 'import os, sys\nimport subprocess\nos.system("ls")\nsubprocess.call(x)\nsubprocess.run (y)\nexec(a); eval(b)'),
    ('py', 'from pickle import loads\nimport yaml.nodes\npickle.loads(a)\npickle.load (b)\nyaml.load(c)\nyaml.safe_load(d)'),
    ('js', "import React from 'react';\nimport 'side.css'\nconst fs = require('fs');\nfunction run(a) { eval(a); new Function (b); setTimeout(c, 1); setInterval\n(d, 2) }"),
    ('js', 'el.innerHTML = "<b>" +\n  name;\ndocument.write(x\n);\ndocument.writeln(y); $(q).html(z); innerHTML(w)'),
    ('java', 'Runtime.exec(a); new ProcessBuilder(b); Class.forName(c); Method.invoke(d);'),
    ('java', 'ObjectInputStream in = f();\nin.readObject();\nRuntime.getRuntime().exec(cmd);'),
    ('php', '<?php eval($a); exec($b); system($c); shell_exec($d); passthru($e); popen($f);'),
    ('php', '<?php unserialize($a); json_decode ($b); $pwd = "x"; $pass: \'multi\nline\';'),
    ('c', '#include <stdlib.h>\nint main() { system("a"); exec("b"); popen("c"); my_system("d"); }'),
    ('cpp', 'class Foo {};\nstd::system(a); exec (b);\npopen(c);'),
    ('py', 'q = "SELECT a FROM t WHERE id = " + x\nr = "insert into t values " + y'),
    ('py', 'q = "UPDATE t SET a = " + x\nr = "DELETE FROM t WHERE a = " + y\ns = "select a\n FROM t\n WHERE b" + c'),
    ('js', 'JSON.parse(a); eval (b)\nclass Shape extends Base {}\nconst area = (w, h) => w * h;\nlet go = function() {}'),
    ('py', 'hashlib.md5(a); SHA1 (b); DES(c); rc4(d); random(e); nodes(f); random.random()'),
    ('ts', "import { a } from './x/../y';\nopen('..\\\\..\\\\boot'); fetch('%2e%2e%2f%2E%2E%5C');"),
    ('py', 'def first(a):\n    return a\n\nasync def second():\n    pass\n\nclass Third(Base, Mixin):\n    def method(self):\n        pass'),
    ('py', 'database = "prod"\ndb_host: "h"\nDB-USER=\'u\'\n"db_pass" = "p"\nfrom . import sibling\nfrom a.b.c import d'),
    ('js', "import x from\n 'late';\nrequire( 'a' ); require (\"b\");import{c}from'd'\nif (x) { for (;;) {} } else { while (1) { switch (y) { case 1: } } }"),
    ('go', 'package main\nimport "fmt"\nfunc main() { fmt.Println("no findings here") }'),
    ('java', 'public class A { String password = "p"; String t = "' + 'x' * 40 + '"; }'),
    ('rb', 'class Plain\n  def go; end\nend'),
]


def code_files(spark, sf) -> DataFrame:
    """repo, path, filename, language, size, content, doc_id: documents with a code snippet inside."""
    return code_files_of(table(spark, sf, 'documents'))


def code_files_of(documents: DataFrame) -> DataFrame:
    """The view always deals its documents to all cores: a test table may be one row group, which is one task."""
    documents = documents.repartition(2 * documents.sparkSession.sparkContext.defaultParallelism, 'doc_id')
    k = F.col('doc_id') % len(SNIPPETS)
    half = F.floor(F.length('text') / 2).cast('int')
    name = F.concat(F.lit('f'), F.col('doc_id').cast('string'), F.lit('.'),
                    pick([s[0] for s in SNIPPETS], k))
    return documents.select(
        F.col('source').alias('repo'), F.concat(F.lit('src/'), name).alias('path'),
        name.alias('filename'), pick([_LANGS[s[0]] for s in SNIPPETS], k).alias('language'),
        F.concat(F.substring(F.col('text'), F.lit(1), half), F.lit('\n'),
                 pick([s[1] for s in SNIPPETS], k), F.lit('\n'),
                 F.substr(F.col('text'), half + 1)).alias('content'), 'doc_id',
        (F.octet_length('text') + 2 + F.octet_length(pick([s[1] for s in SNIPPETS], k)))
        .cast('bigint').alias('size'))


_LANGS = {'py': 'python', 'js': 'javascript', 'ts': 'typescript', 'java': 'java', 'php': 'php',
          'c': 'c', 'cpp': 'cpp', 'go': 'go', 'rb': 'ruby'}
CODE_SQL = f"""code_files AS (
  SELECT repo, 'src/f' || doc_id || '.' || ext AS path, 'f' || doc_id || '.' || ext AS filename,
         language, left(text, half) || chr(10) || snippet || chr(10) || substr(text, half + 1) AS content,
         doc_id
  FROM (SELECT doc_id, source AS repo, text, CAST(length(text) // 2 AS BIGINT) AS half,
          {sql_list(s[0] for s in SNIPPETS)}[doc_id % {len(SNIPPETS)} + 1] AS ext,
          {sql_list(_LANGS[s[0]] for s in SNIPPETS)}[doc_id % {len(SNIPPETS)} + 1] AS language,
          {sql_list(s[1] for s in SNIPPETS)}[doc_id % {len(SNIPPETS)} + 1] AS snippet
        FROM documents))"""

# ---- findings ------------------------------------------------------------------------------
TYPES = ['SQL_INJECTION', 'XSS', 'HARDCODED_SECRETS', 'WEAK_CRYPTO', 'COMMAND_INJECTION',
         'PATH_TRAVERSAL', 'INSECURE_DESERIALIZATION', 'MEMORY_LEAK', None]
_SEVERITY = """CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'WEIRD'
    WHEN event_type = 'error' THEN 'CRITICAL' WHEN event_type = 'purchase' THEN 'HIGH'
    WHEN event_type = 'click' THEN 'MEDIUM' WHEN event_type = 'view' THEN 'low' ELSE 'INFO' END"""
_FINDING_COLUMNS = [
    ("concat('repo', CAST(user_id % 7 AS STRING))", "'repo' || (user_id % 7)", 'repo'),
    ("concat('dir', CAST(user_id div 7 % 5 AS STRING), '/u', CAST(user_id div 7 AS STRING), '.py')",
     "'dir' || (user_id // 7 % 5) || '/u' || (user_id // 7) || '.py'", 'path'),
    ('1 + event_id % 40', '1 + event_id % 40', 'line_number'),
    (_SEVERITY.replace("'low'", "'LOW'"), _SEVERITY.replace("'low'", "'LOW'"), 'severity'),
    ('CAST(50 + event_id % 50 AS DOUBLE) / CAST(100 AS DOUBLE)',
     'CAST(50 + event_id % 50 AS DOUBLE) / CAST(100 AS DOUBLE)', 'confidence'),
    ("concat('finding ', CAST(event_id AS STRING))", "'finding ' || event_id", 'description'),
    ("concat('code ', CAST(event_id % 13 AS STRING))", "'code ' || (event_id % 13)", 'code_snippet'),
    ("concat('fix ', event_type)", "'fix ' || event_type", 'fix_suggestion'),
    ('event_id', 'event_id', 'ord'),
]


def findings(spark, sf) -> DataFrame:
    """Flat findings, one per event: repo, path, line, type, severity, confidence, texts, ord, ts."""
    return findings_of(table(spark, sf, 'events'))


def findings_of(events: DataFrame) -> DataFrame:
    return events.select(*[F.expr(s).alias(n) for s, _, n in _FINDING_COLUMNS],
                    pick(TYPES, F.col('event_id') % len(TYPES)).alias('vulnerability_type'),
                    F.col('ts').alias('found_at'))


FINDINGS_SQL = 'findings AS (SELECT ' + ', '.join(f'{q} AS {n}' for _, q, n in _FINDING_COLUMNS) + f""",
  {sql_list(t or '' for t in TYPES)[:-3]}NULL][event_id % {len(TYPES)} + 1] AS vulnerability_type,
  ts AS found_at FROM events)"""


def static_and_ai(spark, sf) -> tuple[DataFrame, DataFrame]:
    f = findings(spark, sf)
    return f.filter('ord % 2 = 0'), f.filter('ord % 2 = 1').withColumn(
        'line_number', F.col('line_number') + F.when(F.col('ord') % 3 == 0, 1).otherwise(0))


STATIC_AI_SQL = FINDINGS_SQL + """,
static_findings AS (SELECT * FROM findings WHERE ord % 2 = 0),
ai_findings AS (SELECT * REPLACE (line_number + CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END AS line_number)
  FROM findings WHERE ord % 2 = 1)"""

FILE_LANGUAGES = ['python', 'java', '', 'go']


def analyzed_files(spark, sf) -> DataFrame:
    """repo, path, language: the files behind the findings and clean ones, one per customer."""
    k = F.col('c_custkey')
    return table(spark, sf, 'customer').select(
        F.concat(F.lit('repo'), (k % 7).cast('string')).alias('repo'),
        F.expr("concat('dir', CAST(c_custkey div 7 % 5 AS STRING), '/u', CAST(c_custkey div 7 AS STRING), '.py')")
        .alias('path'), pick(FILE_LANGUAGES, F.col('c_nationkey') % 4).alias('language'))


ANALYZED_SQL = f"""analyzed_files AS (SELECT 'repo' || (c_custkey % 7) AS repo,
  'dir' || (c_custkey // 7 % 5) || '/u' || (c_custkey // 7) || '.py' AS path,
  {sql_list(FILE_LANGUAGES)}[c_nationkey % 4 + 1] AS language FROM customer)"""

# ---- predictions and ground truth ----------------------------------------------------------


def predictions(spark, sf) -> DataFrame:
    e = table(spark, sf, 'events')
    return e.select(F.expr("concat('dir/u', CAST(user_id % 40 + 100 AS STRING), '.py')").alias('file'),
                    pick(TYPES[:8], F.col('event_id') % 8).alias('type'),
                    F.expr('1 + event_id % 250').alias('line'), F.col('event_id').alias('ord'))


def ground_truth(spark, sf) -> DataFrame:
    """Truth lines lie four apart within a (file, type)."""
    e = table(spark, sf, 'events')
    return (e.select(F.expr("concat('u', CAST(user_id % 40 + 100 AS STRING), '.py')").alias('file'),
                     pick(TYPES[:8], F.floor(F.col('event_id') / 3) % 8).alias('type'),
                     F.expr('4 * (1 + event_id % 50)').alias('line'))
            .distinct())


TRUTH_SQL = f"""predictions AS (
  SELECT 'u' || (user_id % 40 + 100) || '.py' AS file, {sql_list(TYPES[:8])}[event_id % 8 + 1] AS type,
         1 + event_id % 250 AS line, event_id AS ord FROM events),
ground_truth AS (
  SELECT DISTINCT 'u' || (user_id % 40 + 100) || '.py' AS file,
         {sql_list(TYPES[:8])}[(event_id // 3) % 8 + 1] AS type, 4 * (1 + event_id % 50) AS line
  FROM events)"""

# ---- snapshots -----------------------------------------------------------------------------


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(base, head): head misses some files, changes some and adds some; repository 'same' is unchanged."""
    base = files(spark, sf)
    same = base.filter('doc_id % 13 = 0').withColumn('repo', F.lit('same'))
    kept = base.filter('doc_id % 7 <> 0').withColumn(
        'content', F.when(F.col('doc_id') % 5 == 0, F.concat('content', F.lit('x')))
        .otherwise(F.col('content')))
    added = base.filter('doc_id % 11 = 0').withColumn('path', F.concat('path', F.lit('.new')))
    return base.unionByName(same), kept.unionByName(added).unionByName(same)


SNAPSHOT_SQL = FILES_SQL + """,
base AS (SELECT * FROM files UNION ALL SELECT * REPLACE ('same' AS repo) FROM files WHERE doc_id % 13 = 0),
head AS (SELECT * REPLACE (content || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END AS content)
         FROM files WHERE doc_id % 7 <> 0
         UNION ALL SELECT * REPLACE (path || '.new' AS path) FROM files WHERE doc_id % 11 = 0
         UNION ALL SELECT * REPLACE ('same' AS repo) FROM files WHERE doc_id % 13 = 0)"""

# ---- requests, scan log, history -----------------------------------------------------------
MODELS = ['model-a', 'model-b', 'model-c', 'model-d']


def requests(spark, sf) -> DataFrame:
    return table(spark, sf, 'events').select(
        F.col('event_id').alias('request_id'), F.col('user_id').alias('key'), 'ts',
        pick(MODELS, F.col('user_id') % 4).alias('model'))


REQUESTS_SQL = f"""requests AS (SELECT event_id AS request_id, user_id AS key, ts,
  {sql_list(MODELS)}[user_id % 4 + 1] AS model FROM events)"""

_STATUS = """CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error'
    THEN 'failed' ELSE 'processing' END"""


def scan_log(spark, sf) -> DataFrame:
    return scan_log_of(table(spark, sf, 'events'))


def scan_log_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col('user_id').alias('analysis_id'), F.expr(_STATUS).alias('status'), 'ts', 'event_id',
        F.expr('event_id % 60').alias('progress'), F.expr('user_id % 20').alias('file_count'))


SCAN_LOG_SQL = f"""scan_log AS (SELECT user_id AS analysis_id, {_STATUS} AS status, ts, event_id,
  event_id % 60 AS progress, user_id % 20 AS file_count FROM events)"""


def history(spark, sf) -> DataFrame:
    return history_of(table(spark, sf, 'events'))


def history_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.expr('user_id % 50').alias('repo_id'), F.col('event_id').alias('ord'), 'ts',
        F.expr('event_id % 300').alias('repo_score'), F.expr('event_id % 4').alias('critical'),
        F.expr('event_id % 6').alias('high'))


HISTORY_SQL = """history AS (SELECT user_id % 50 AS repo_id, event_id AS ord, ts,
  event_id % 300 AS repo_score, event_id % 4 AS critical, event_id % 6 AS high FROM events)"""

# ---- manifests, advisories, commits --------------------------------------------------------
MANIFEST_NAMES = ['requirements.txt', 'package.json', 'Cargo.toml', 'go.mod', 'poetry.lock',
                  'package.json']
_P = [('{n}', "CAST(p_partkey % 50 AS STRING)"), ('{v}', "CAST(p_size AS STRING)"),
      ('{m}', "CAST(p_partkey % 7 AS STRING)")]
MANIFEST_TEXTS = [
    'pkg{n}==1.{v}\n# note\n\n  flask >= 2.{m}  \nlib{n}[extra]==1\n-r base.txt\nbare-name\nodd~=\nA_b.c!=3.{v}-rc1\n@bad\n',
    '{"name": "app", "dependencies": {"pkg{n}": "1.{v}", "left-pad": "^1.{m}"}, "devDependencies": {"jest": "{v}.0"}, "peerDependencies": null}',
    '[package]\nname = "app"\nversion = "0.1.0"\n\n[dependencies]\npkg{n} = "1.{v}"\nserde = { version = "1.{m}", features = ["derive"] }\nlocal = { path = "../local" }\n\n[dev-dependencies]\nskipme = "9"\n',
    'module example.com/app\n\ngo 1.2{m}\n\nrequire pkg{n} v1.{v}\nrequire (\n\tgolang.org/x/net v0.{v}.0 // indirect\n)\n// note\nreplace a => b\n',
    '[[package]]\nname = "locked{n}"\n',
    '{"name": "broken{n}", "dependencies": {',
]


def _spark_template(text: str) -> Column:
    expr = F.lit(text)
    for mark, value in _P:
        expr = F.replace(expr, F.lit(mark), F.expr(value))
    return expr


def _sql_template(text: str) -> str:
    expr = quoted(text)
    for mark, value in _P:
        expr = f"replace({expr}, '{mark}', {value.replace('STRING', 'VARCHAR')})"
    return expr


def manifests(spark, sf) -> DataFrame:
    """repo, manifest (path), filename, content: one manifest per part, dealt to all cores as in :func:`code_files_of`."""
    p = table(spark, sf, 'part').repartition(2 * spark.sparkContext.defaultParallelism, 'p_partkey')
    kind = F.col('p_partkey') % len(MANIFEST_NAMES)
    content = F.when(F.lit(False), '')
    for i, text in enumerate(MANIFEST_TEXTS):
        content = content.when(kind == i, _spark_template(text))
    return p.select(F.concat(F.lit('repo'), (F.col('p_partkey') % 7).cast('string')).alias('repo'),
                    F.concat(F.lit('m'), F.col('p_partkey').cast('string'), F.lit('/'),
                             pick(MANIFEST_NAMES, kind)).alias('manifest'),
                    pick(MANIFEST_NAMES, kind).alias('filename'), content.alias('content'))


_WHEN = ' '.join(f'WHEN {i} THEN {_sql_template(t)}' for i, t in enumerate(MANIFEST_TEXTS))
MANIFESTS_SQL = f"""manifests AS (
  SELECT 'repo' || (p_partkey % 7) AS repo,
    'm' || p_partkey || '/' || {sql_list(MANIFEST_NAMES)}[p_partkey % {len(MANIFEST_NAMES)} + 1] AS manifest,
    {sql_list(MANIFEST_NAMES)}[p_partkey % {len(MANIFEST_NAMES)} + 1] AS filename,
    CASE p_partkey % {len(MANIFEST_NAMES)} {_WHEN} END AS content FROM part)"""

ECOSYSTEMS = ['PyPI', 'npm', 'crates.io', 'Go']
SCORES = ['9.8/AV:N', '7.0', '4.5/x', '3.9', 'CVSS:3.1/AV:N', 'NaN', '', '8.9']


def advisories(spark, sf) -> DataFrame:
    """id, ecosystem, name, versions, severity (array of type and score): one per supplier, dealt to all cores as in :func:`code_files_of`."""
    s = table(spark, sf, 'supplier').repartition(2 * spark.sparkContext.defaultParallelism, 's_suppkey')
    k = F.col('s_suppkey')

    def score(kind, index):
        return F.struct(F.lit(kind).alias('type'), pick(SCORES, index % 8).alias('score'))
    both = F.array(score('CVSS_V3', k), score('CVSS_V2', k + 1))
    return s.select(
        F.concat(F.lit('ADV-'), k.cast('string')).alias('id'),
        pick(ECOSYSTEMS, k % 4).alias('ecosystem'),
        F.concat(F.lit('pkg'), (k % 50).cast('string')).alias('name'),
        F.transform(F.sequence(k % 3, k % 3 + 25), lambda i: F.concat(F.lit('1.'), i.cast('string')))
        .alias('versions'),
        F.when(k % 5 == 0, F.array(score('OTHER', k))).when(k % 11 == 0, F.lit(None))
        .otherwise(both).alias('severity'),
        F.concat(F.lit('issue in '), F.col('s_name')).alias('summary'))


def _score(kind, index):
    return f"{{'type': '{kind}', 'score': {sql_list(SCORES)}[{index} % 8 + 1]}}"


ADVISORIES_SQL = f"""advisories AS (
  SELECT 'ADV-' || s_suppkey AS id, {sql_list(ECOSYSTEMS)}[s_suppkey % 4 + 1] AS ecosystem,
    'pkg' || (s_suppkey % 50) AS name,
    list_transform(generate_series(s_suppkey % 3, s_suppkey % 3 + 25), lambda i: '1.' || i) AS versions,
    CASE WHEN s_suppkey % 5 = 0 THEN [{_score('OTHER', 's_suppkey')}]
         WHEN s_suppkey % 11 = 0 THEN NULL
         ELSE [{_score('CVSS_V3', 's_suppkey')}, {_score('CVSS_V2', '(s_suppkey + 1)')}] END AS severity,
    'issue in ' || s_name AS summary FROM supplier)"""


def ranged_advisories(spark, sf) -> DataFrame:
    """Advisories that say by ranges which versions they are about; some ends are open or pre-releases."""
    k = F.regexp_extract('id', '[0-9]+', 0).cast('bigint')
    minor = lambda n: F.concat(F.lit('1.'), n.cast('string'))
    fixed = F.when(k % 7 == 0, F.lit(None)).when(k % 4 == 1, F.concat(minor(k % 5 + 8), F.lit('-rc.1'))).otherwise(minor(k % 5 + 8))
    first = F.struct(F.when(k % 3 == 0, '0').otherwise(minor(k % 5)).alias('introduced'), fixed.alias('fixed'))
    second = F.struct(minor(k % 6 + 20).alias('introduced'), minor(k % 6 + 30).alias('fixed'))
    return advisories(spark, sf).withColumn('versions', F.when(k % 6 == 0, F.array(F.lit('1.45')))).withColumn('ranges', F.array(first, second))


RANGED_SQL = """ranged AS (
  SELECT id, ecosystem, name, summary, CAST(substr(id, 5) AS BIGINT) AS k FROM advisories),
spans AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 5 END AS low, CASE WHEN k % 7 = 0 THEN 1000 ELSE k % 5 + 8 END AS high FROM ranged
  UNION ALL SELECT *, k % 6 + 20, k % 6 + 30 FROM ranged)"""


def commits(spark, sf) -> DataFrame:
    return table(spark, sf, 'orders').select(
        F.col('o_custkey').alias('repo'), F.md5(F.col('o_orderkey').cast('string')).alias('sha'),
        F.concat(F.lit('Fix '), F.col('o_orderpriority'), F.lit('\nlonger text')).alias('message'),
        F.col('o_orderdate').alias('date'), F.col('o_orderkey').alias('ord'))


COMMITS_SQL = """commits AS (SELECT o_custkey AS repo, md5(CAST(o_orderkey AS VARCHAR)) AS sha,
  'Fix ' || o_orderpriority || chr(10) || 'longer text' AS message, o_orderdate AS date,
  o_orderkey AS ord FROM orders)"""

# ---- model replies and repository URLs -----------------------------------------------------
_REPLY = [
    ('Here is the result:\n```json\n{"vulnerabilities": [{"line_number": ', 'lit'),
    ("CAST(event_id % 40 + 1 AS STRING)", 'expr'),
    (', "vulnerability_type": "XSS", "severity": "HIGH", "description": "d", "confidence": 0.9}, '
     '{"line_number": 7, "vulnerability_type": "CSRF", "severity": "LOW"}]', 'lit'),
    ("CASE WHEN event_id % 3 = 0 THEN '' ELSE ', \"summary\": {\"total_vulnerabilities\": 2, "
     "\"critical_count\": 0, \"high_count\": 1, \"low_count\": 1}' END", 'expr'),
    ("CASE WHEN event_id % 4 = 0 THEN ', \"metadata\": {\"gemini_tokens_used\": 11}' "
     "WHEN event_id % 4 = 1 THEN ', \"metadata\": {\"tokens_used\": 5}' ELSE '' END", 'expr'),
    ('}\n```\nDone.', 'lit'),
]


def _reply_spark() -> Column:
    return F.concat(*[F.lit(v) if kind == 'lit' else F.expr(v) for v, kind in _REPLY])


_REPLY_SQL = ' || '.join(quoted(v) if kind == 'lit' else '(' + v.replace('STRING', 'VARCHAR') + ')'
                         for v, kind in _REPLY)
EMPTY_REPLY = 'Nothing. {"note": "no list"} end'
BROKEN_REPLY = 'Sure: {"vulnerabilities": [{"line_number": 1, ' + 'z' * 600 + '}'
PROSE_REPLY = 'I could not find anything. ' * 30


def ai_responses(spark, sf) -> DataFrame:
    e, k = table(spark, sf, 'events'), F.col('event_id') % 10
    return e.select(
        F.col('event_id').alias('reply_id'),
        F.concat(F.lit('u'), F.col('user_id').cast('string'), F.lit('.py')).alias('filename'),
        pick(MODELS, F.col('user_id') % 4).alias('model_used'),
        F.expr('100 + event_id % 1000').alias('code_length'),
        F.when(k == 7, F.lit(EMPTY_REPLY)).when(k == 8, F.lit(BROKEN_REPLY))
        .when(k == 9, F.lit(PROSE_REPLY)).when(F.col('event_id') % 50 == 5, F.lit(None))
        .otherwise(_reply_spark()).alias('reply'))


REPLIES_SQL = f"""ai_responses AS (SELECT event_id AS reply_id, 'u' || user_id || '.py' AS filename,
  {sql_list(MODELS)}[user_id % 4 + 1] AS model_used, 100 + event_id % 1000 AS code_length,
  CASE WHEN event_id % 10 = 7 THEN {quoted(EMPTY_REPLY)} WHEN event_id % 10 = 8 THEN {quoted(BROKEN_REPLY)}
       WHEN event_id % 10 = 9 THEN {quoted(PROSE_REPLY)} WHEN event_id % 50 = 5 THEN NULL
       ELSE {_REPLY_SQL} END AS reply FROM events)"""

URL_HEADS = ['https://github.com/', 'https://gitlab.com/', 'https://bitbucket.org/team/',
             'https://example.org/git/', 'git@github.com:x/']
URL_TAILS = ['', '.git', '.git.git', '/tree.git/main']


def repos(spark, sf) -> DataFrame:
    p = table(spark, sf, 'pages')
    k = F.col('page_id')
    return p.select('page_id', F.when(k % 6 == 5, F.col('url')).otherwise(F.concat(
        pick(URL_HEADS, k % 5), F.lit('own'), (k % 9).cast('string'), F.lit('/'),
        F.substring(F.md5('url'), 1, 6), pick(URL_TAILS, F.floor(k / 5) % 4))).alias('url'))


REPOS_SQL = f"""repos AS (SELECT page_id, CASE WHEN page_id % 6 = 5 THEN url ELSE
  {sql_list(URL_HEADS)}[page_id % 5 + 1] || 'own' || (page_id % 9) || '/' || left(md5(url), 6)
  || {sql_list(URL_TAILS)}[(page_id // 5) % 4 + 1] END AS url FROM pages)"""


def with_sql(*views: str, body: str) -> str:
    return 'WITH ' + ',\n'.join(views) + '\n' + body
