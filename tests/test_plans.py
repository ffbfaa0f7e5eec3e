"""Whole scans on small inputs."""

from pyspark.sql import functions as F

from codefindings.plans import repo_scan

FILES = [('r1', 'a.py', 'eval(x)\n'), ('r1', 'b.py', 'md5(x) is used in this file\n'), ('r2', 'c.py', 'nothing to see here\n'),
         ('r2', 'node_modules/d.py', 'eval(x)\n'), ('r2', 'e.js', 'open("../x"); open("../y")')]


def source(spark):
    df = spark.createDataFrame(FILES, 'repo string, path string, content string')
    return df.withColumn('filename', F.substring_index('path', '/', -1)).withColumn('size', F.octet_length('content').cast('bigint'))


def test_repository_scan(spark):
    risk = spark.createDataFrame([('r2', 7)], 'repo string, dependency_risk long')
    rows = {r.repo: r for r in repo_scan.scan_repository(source(spark), risk).collect()}
    r1, r2 = rows['r1'], rows['r2']
    # eval: a dangerous call; md5: weak crypto.
    assert (r1.files_discovered, r1.files_with_issues, r1.critical, r1.total, r1.risk_level) == (2, 2, 2, 2, 'CRITICAL')
    assert (r2.files_discovered, r2.files_with_issues, r2.high, r2.total, r2.risk_level) == (2, 1, 2, 2, 'MEDIUM')
    assert (r1.repo_score, r2.repo_score, r2.languages) == (20, 17, 'javascript,python')


def test_changed_files_only(spark):
    risk = spark.createDataFrame([], 'repo string, dependency_risk long')
    changed = spark.createDataFrame([('r1', 'b.py'), ('r1', 'gone.py')], 'repo string, path string')
    rows = {r.repo: r for r in repo_scan.scan_repository(source(spark), risk, changed).collect()}
    assert (rows['r1'].files_discovered, rows['r1'].total) == (1, 1)
    assert rows['r2'].files_discovered == 2


def test_staged_scan(spark):
    files = source(spark).withColumn('language', F.lit('python'))
    asked = spark.createDataFrame([('default', 'Review')], 'language string, instruction string')
    replies = spark.createDataFrame([
        ('r1', 'a.py', '{"vulnerabilities": [{"line_number": 1, "vulnerability_type": "CSRF", "severity": "LOW"}]}'),
        ('r2', 'c.py', 'x {"vulnerabilities": [{"line_number": 1, "vulnerability_type": "CSRF", "severity": "LOW"}]}'),
        ('r2', 'e.js', 'no json')], 'repo string, path string, reply string')
    done = repo_scan.staged(files, asked, repo_scan.model_findings(replies))
    assert {r.path for r in done.prompts.collect()} == {'c.py', 'e.js'}
    assert {r.path for r in done.skipped.collect()} == {'a.py', 'b.py', 'node_modules/d.py'}
    found = {(r.path, r.vulnerability_type) for r in done.findings.collect()}
    assert found == {('a.py', 'DANGEROUS_FUNCTION'), ('b.py', 'WEAK_CRYPTO'), ('c.py', 'CSRF'), ('e.js', 'PATH_TRAVERSAL'),
                     ('node_modules/d.py', 'DANGEROUS_FUNCTION')}


def test_same_path_in_two_repositories(spark):
    files = spark.createDataFrame([('r1', 'm.py', 'python', 'eval(x)'), ('r2', 'm.py', 'python', 'x = 1\n' * 5000 + 'open("../y")')],
                                  'repo string, path string, language string, content string')
    asked = spark.createDataFrame([('default', 'Review')], 'language string, instruction string')
    none = spark.createDataFrame([], 'repo string, path string, reply string')
    done = repo_scan.staged(files, asked, repo_scan.model_findings(none))
    prompts = done.prompts.collect()
    assert [(r.repo, r.path) for r in done.skipped.collect()] == [('r1', 'm.py')]
    assert {(r.repo, r.path) for r in prompts} == {('r2', 'm.py')} and len(prompts) == 26
    assert sum('5001: open("../y")' in r.prompt for r in prompts) == 1


def test_no_exchange_carries_contents(spark):
    risk = spark.createDataFrame([('r9', 7)], 'repo string, dependency_risk long')
    scanned = repo_scan.scan_repository(source(spark), risk)
    assert {r.repo: r.files_discovered for r in scanned.collect()}['r9'] == 0
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split('\n') if 'Exchange' in x and 'content' in x]
