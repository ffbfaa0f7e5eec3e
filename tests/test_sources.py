"""File trees, decoding, manifests, replies and sinks."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codefindings.dims import names
from codefindings.functions.versions import version_key
from codefindings.operators import dependencies, replies
from codefindings.sources import files as sources, sinks, trees

PY = 'import os\nos.system("ls")\n'


def test_tree_discovery(spark, tmp_path):
    root = tmp_path / 'tree'
    content = {'src/a.py': PY, 'node_modules/b.py': PY, 'src/.hidden': PY, 'docs/readme.md': 'hello world', 'src/empty.py': '',
               'x/logo.png': PY, 'x/bin.dat': '\x00' * 50, 'x/.env': 'A=1', 'Build/c.py': PY, 'deep/a/b/c/__init__.py': PY, 'x/a.min.js': PY, 'build.py': PY}
    for path, text in content.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / 'src' / 'loop').symlink_to(root)
    roots = spark.createDataFrame([('r', root.as_uri())], 'repo string, root string')
    found = {r.path: r for r in sources.discover_trees(roots).collect()}
    assert set(found) == {'src/a.py', 'docs/readme.md', 'x/.env', 'build.py', 'deep/a/b/c/__init__.py'}
    assert found['src/a.py'].language == 'python' and bytes(found['src/a.py'].content) == PY.encode()
    assert 'node_modules' not in {r.path.split('/')[0] for r in trees.list_trees(roots).collect()}
    upload = {r.path: r.content for r in sources.discover_trees(roots, 'upload').collect()}
    assert upload['deep/a/b/c/__init__.py'] == PY and 'x/.env' in upload


def test_linked_folders_have_a_row(spark, tmp_path):
    (tmp_path / 'r' / 'src').mkdir(parents=True)
    (tmp_path / 'r' / 'src' / 'a.py').write_text(PY)
    (tmp_path / 'r' / 'loop').symlink_to(tmp_path / 'r')
    (tmp_path / 'r' / 'node_modules').symlink_to(tmp_path)
    roots = spark.createDataFrame([('r', (tmp_path / 'r').as_uri())], 'repo string, root string')
    got = {r.path: (r.status, r.content is not None) for r in sources.report_trees(roots).collect()}
    assert got == {'src/a.py': ('scanned', True), 'loop': ('linked_dir', False)}


@pytest.mark.parametrize('most', [1, 3, 500])
def test_deep_and_wide_trees_are_listed_whole(spark, tmp_path, most):
    want, folder = {}, tmp_path
    for i in range(12):
        folder = folder / f'd{i}'
        folder.mkdir()
        (folder / 'x.py').write_text('x' * i)
        want[str((folder / 'x.py').relative_to(tmp_path))] = i
    for i in range(40):
        (tmp_path / 'wide' / f'w{i}').mkdir(parents=True)
        (tmp_path / 'wide' / f'w{i}' / 'y.py').write_text('y')
        want[f'wide/w{i}/y.py'] = 1
    roots = spark.createDataFrame([('r', tmp_path.as_uri()), ('s', (tmp_path / 'wide').as_uri())], 'repo string, root string')
    found = trees.list_trees(roots, folders_per_task=most).collect()
    assert {r.path: r.size for r in found if r.repo == 'r'} == want and len(found) == len(want) + 40


def test_status_tells_what_was_not_scanned(spark, tmp_path):
    (tmp_path / 'logs').mkdir()
    for name, text in {'a.py': PY, 'b.py': PY * 40, 'logs/c.py': PY, 'd.bin': 'x', 'e.py': '', 'f.txt': '\x00' * 50, 'z.py': PY}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / 'g.py').symlink_to(tmp_path / 'nowhere')
    roots = spark.createDataFrame([('r', tmp_path.as_uri()), ('gone', (tmp_path / 'none').as_uri())], 'repo string, root string')
    status = lambda **k: {(r.repo, r.path): r.status for r in sources.report_trees(roots, **k).collect()}
    got = status()
    assert got == {('r', 'a.py'): 'scanned', ('r', 'b.py'): 'scanned', ('r', 'z.py'): 'scanned', ('r', 'd.bin'): 'ignored_name',
                   ('r', 'e.py'): 'empty', ('r', 'f.txt'): 'not_text', ('gone', ''): 'missing_root'} | {
                       k: v for k, v in got.items() if k[1] == 'g.py'}
    limited = status(max_file=500, max_tree=60)
    assert limited['r', 'b.py'] == 'too_large' and limited['r', 'z.py'] == 'over_budget' and limited['r', 'a.py'] == 'scanned'
    counts = {(r.repo, r.status): r.n_files for r in sources.status_counts(sources.report_trees(roots)).collect()}
    assert counts['r', 'scanned'] == 3 and counts['gone', 'missing_root'] == 1


def test_large_files_are_scanned_by_default(spark):
    rows = [(repo, f'p{i:03d}.py', 'f.py', 30 * names.MIB, 'text here') for repo in ('big', 'small') for i in range(30 if repo == 'big' else 3)]
    df = spark.createDataFrame(rows, 'repo string, path string, filename string, size long, content string')
    count = lambda **k: {r.repo: (r.n, r.last) for r in sources.discover(df, **k).groupBy('repo')
                         .agg(F.count('*').alias('n'), F.max('path').alias('last')).collect()}
    assert count() == {'big': (30, 'p029.py'), 'small': (3, 'p002.py')}
    assert count(max_tree=500 * names.MIB) == {'big': (16, 'p015.py'), 'small': (3, 'p002.py')}
    assert count(max_file=20 * names.MIB) == {}


def test_decode(spark):
    cases = {'utf-8': 'é'.encode(), 'utf-16': '﻿é漢'.encode('utf-16-le'), 'latin-1': b'caf\xe9!', 'empty': b''}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()] + [('null', None)], 'k string, content binary')
    got = {r.k: (r.text, r.encoding) for r in sources.decode(df).collect()}
    assert got == {'utf-8': ('é', 'utf-8'), 'utf-16': ('é漢', 'utf-16'), 'latin-1': ('café!', 'latin-1'),
                   'empty': ('', 'utf-8'), 'null': (None, None)}


def manifest(spark, name, text):
    return spark.createDataFrame([('r', 'm/' + name, name, text)], 'repo string, manifest string, filename string, content string')


def deps(spark, name, text):
    return [(r.name, r.version) for r in dependencies.all_dependencies(manifest(spark, name, text)).collect()]


def test_manifests(spark):
    assert deps(spark, 'requirements.txt', 'a==1\r\nb >= 2.0\n#c\n\n d~=\ne[x]==3\n-r f.txt\n@g\nh != 1-2') == [
        ('a', '1'), ('b', '2.0'), ('d', '*'), ('e', '*'), ('-r', 'f.txt'), ('h', '1-2')]
    assert sorted(deps(spark, 'package.json', json.dumps({'dependencies': {'a': '^1'}, 'devDependencies': {'b': 2}, 'peerDependencies': None}))) == [
        ('a', '^1'), ('b', '2')]
    for bad in ('{', '[]', "{'dependencies': {'a': '1'}}", '{"dependencies": ["a"]}'):
        assert deps(spark, 'package.json', bad) == []
    assert deps(spark, 'Cargo.toml', '[dependencies]\na = "1"\nb = { version = "2", x = 1 }\nc = { path = "." }\n[dependencies.d]\nversion = "4"\n') == [
        ('a', '1'), ('b', '2'), ('c', '*'), ('d', '4')]
    assert deps(spark, 'Cargo.toml', 'not toml [') == []
    assert deps(spark, 'go.mod', 'module x\ngo 1.21\nrequire a v1\nrequire (\n\tb v2 // indirect\n)\n// c v3\nreplace d => e') == [
        ('go', '1.21'), ('a', 'v1'), ('b', 'v2'), ('replace', 'd')]
    assert deps(spark, 'poetry.lock', 'x = 1') == []


def test_replies(spark):
    cases = [None, 'none', '{"a": 1}', 'x {"vulnerabilities": [{"line_number": 3}]} y', '{"a": 1} and {"b": 2}', '{"a": ', '{}, {}',
             "{'a': 1}", '{"summary": {"total_vulnerabilities": 4}, "vulnerabilities": null}']
    df = spark.createDataFrame(list(enumerate(cases)), 'i int, reply string')
    parsed = replies.parse(df)
    good = {r.i: (len(r.vulnerabilities), r.total_vulnerabilities) for r in replies.good(parsed).collect()}
    assert good == {2: (0, 0), 3: (1, 1), 8: (0, 4)}
    bad = {r.i: r.error for r in replies.errors(parsed).collect()}
    assert bad == {0: 'no_reply', 1: 'no_json', 4: 'bad_json', 5: 'no_json', 6: 'bad_json', 7: 'bad_json'}
    assert [(r.i, r.line_number) for r in replies.findings(replies.good(parsed), ['i']).collect()] == [(3, 3)]


def test_stored_results(spark):
    doc = {'t1': {'metadata': {'filename': 'd/a.py'}, 'vulnerabilities': [{'line_number': 0, 'line': 4, 'vulnerability_type': ' xss '}]},
           't2': {'file': 'b.py', 'vulnerabilities': [{'type': 'csrf'}]}, 'c/t3.py': {'vulnerabilities': [{'line_number': 2}]}, 't4': {}}
    df = spark.createDataFrame([(json.dumps(doc),)], 'json string')
    got = sorted((r.file, r.type, r.line) for r in replies.stored_predictions(df).collect())
    assert got == [('a.py', 'XSS', 4), ('b.py', 'CSRF', -1), ('t3.py', '', 2)]


def test_sinks_replace_and_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'r', 1, 0), (2, 's', 0, 0)], 'scan_id int, repo string, critical int, high int')
    for _ in range(2):
        sinks.append_alerts(rows, str(tmp_path / 'alerts'), 7)
    assert spark.read.parquet(str(tmp_path / 'alerts')).count() == 1
    history = spark.range(30).selectExpr('1 AS k', 'id AS ord', "timestamp_ntz'2024-01-01 10:20:00' AS ts")
    sinks.append_history(history.filter('ord < 15'), str(tmp_path / 'h'))
    sinks.append_history(history.filter('ord >= 15'), str(tmp_path / 'h'))
    last = sinks.read_history(spark, str(tmp_path / 'h'), ['k']).collect()
    assert sorted(r.ord for r in last) == list(range(10, 30)) and last[0].label == '10:20'


TOML = [
    ('[dependencies]\na = "1"\n"b.c" = \'2\'\nd = { version = "3", features = [\n  "x", # no\n  "y",\n] }\n[dev-dependencies]\nz = "9"',
     [('a', '1'), ('b.c', '2'), ('d', '3')]),
    ('dependencies.a = "1"\ndependencies.b.version = "2"\n', [('a', '1'), ('b', '2')]),
    ('[package]\ndescription = """\n[dependencies]\nnot = "1"\n"""\n[dependencies.real]\ngit = "x"\n', [('real', '*')]),
    ('[target."cfg(unix)".dependencies]\nnix = "0.2"\n[dependencies]\nversion = ""\nn = 3\ne = { version = "" }', [('version', ''), ('n', '3'), ('e', '*')]),
    ('dependencies = 3', []), ('[dependencies]\na = "1"\na = "2"', []), ('', []), ('target = 1', []),
]


def test_toml_manifests_of_every_form(spark):
    rows = [('r', f'{i}/Cargo.toml', 'Cargo.toml', text) for i, (text, _) in enumerate(TOML)] + [('r', 'n/Cargo.toml', 'Cargo.toml', None)]
    frame = spark.createDataFrame(rows, 'repo string, manifest string, filename string, content string')
    got = [[(r.name, r.version) for r in dependencies.all_dependencies(frame.filter(F.col('manifest') == f'{i}/Cargo.toml')).collect()]
           for i in range(len(TOML))]
    assert got == [want for _, want in TOML]
    assert dependencies.all_dependencies(frame).count() == sum(len(w) for _, w in TOML)
    more = dependencies.cargo_toml(frame, targets=True).filter("manifest = '3/Cargo.toml'")
    assert ('nix', '0.2') in [(r.name, r.version) for r in more.collect()]


ORDERED = ['0', '0.0.1', '1.0.dev1', '1.0-alpha', '1.0.0-alpha.1', '1.0-alpha.2', '1.0-alpha.beta', '1.0b2', '1.0-beta.11', 'v1.0.0-rc.1', '1.0rc10', '1.0',
           '1.0.post1', '1.0.1', '1.2', '1.10', '1.10.0.1', '2.0.0-pre', '2', '10.0', '20240101.1', '123456789012345678901.0']


def test_version_keys_keep_the_order(spark):
    frame = spark.createDataFrame(list(enumerate(ORDERED)), 'i int, v string').withColumn('k', version_key(F.col('v')))
    assert [r.i for r in frame.orderBy('k').collect()] == list(range(len(ORDERED)))
    same = [('1.0', '1.0.0'), ('v2', '2.0+build.5'), ('1.0a1', '1.0-alpha.1'), ('=1.2', ' 1.2 '), ('1.0c2', '1.0.rc2'), ('01.2', '1.02')]
    pairs = spark.createDataFrame(same, 'a string, b string').select((version_key(F.col('a')) == version_key(F.col('b'))).alias('x'))
    assert all(r.x for r in pairs.collect())
    odd = spark.createDataFrame([('',), ('latest',), ('*',), (None,), ('^1.2',)], 'v string')
    assert [r.k for r in odd.select(version_key(F.col('v')).alias('k')).collect()] == [None] * 5


def test_ranges_meet_versions(spark):
    rng = random.Random(2)
    place = {v: i for i, v in enumerate(ORDERED)}
    known, listed = [], []
    for i in range(200):
        spans = []
        for _ in range(rng.randrange(3)):
            a, b = sorted(rng.sample(range(len(ORDERED)), 2))
            spans.append((rng.choice([ORDERED[a], ORDERED[a], '0', None]), rng.choice([ORDERED[b], ORDERED[b], None])))
        listed.append((i % 3, spans, rng.sample(ORDERED, 2) if i % 5 == 0 else None))
        known.append((f'A{i}', 'npm', f'p{i % 3}', listed[-1][2], [{'introduced': a, 'fixed': b} for a, b in spans] or None, None, 's'))
    found = [(f'r{i % 4}', 'm', 'npm', f'p{rng.randrange(4)}', rng.choice([*ORDERED, '*', 'odd'])) for i in range(300)]
    deps_ = spark.createDataFrame(found, 'repo string, manifest string, ecosystem string, name string, version string')
    advisories = spark.createDataFrame(known, 'id string, ecosystem string, name string, versions array<string>, ranges array<struct<introduced:string,'
                                       'fixed:string>>, severity array<struct<type:string,score:string>>, summary string')

    def hit(version, spans, versions):
        at = place.get(version)
        return version == '*' or version in (versions or ()) or (at is not None and any(
            (a is None or place[a] <= at) and (b is None or at < place[b]) for a, b in spans))
    want = Counter((*d, f'A{i}') for d in found for i, (k, spans, versions) in enumerate(listed) if d[3] == f'p{k}' and hit(d[4], spans, versions))
    got = Counter((r.repo, r.manifest, r.ecosystem, r.name, r.version, r.id) for r in dependencies.advisories_for(deps_, advisories).collect())
    assert got == want and len(want) > 500
    assert dependencies.advisories_for(deps_.limit(0), advisories).count() == 0
    assert dependencies.advisories_for(deps_, advisories.limit(0)).count() == 0


def test_advisories_are_not_broadcast_by_version(spark, capsys):
    # One short row holds versions that make many rows, so its size says nothing about the join's.
    deps_ = spark.createDataFrame([('r', 'm', 'npm', 'a', '1.7')], 'repo string, manifest string, ecosystem string, name string, version string')
    advisories = spark.range(2).selectExpr("concat('A', id) AS id", "'npm' AS ecosystem", "'a' AS name", "transform(sequence(0, 999), i -> concat('1.', i)) AS versions",
                                           "CAST(NULL AS array<struct<type: string, score: string>>) AS severity", "'s' AS summary")
    found = dependencies.advisories_for(deps_, advisories)
    assert found.count() == 2
    found.explain()
    plan = capsys.readouterr().out
    assert 'SortMergeJoin' in plan and 'BroadcastHashJoin' not in plan


def test_ranges_make_version_keys_of_distinct_versions(spark, monkeypatch):
    # Dependencies are parsed once, and only distinct versions and ranges of a package get keys.
    parsed, keyed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(counter):
        def add(text):
            counter.add(1)
            return text
        return F.udf(add)
    monkeypatch.setattr(dependencies, 'version_key', lambda v: version_key(counted(keyed)(v)))
    # Rows of names without advisories are as many, and two of the ranges overlap.
    deps_ = spark.range(4000, numPartitions=2).select(
        F.lit('r').alias('repo'), F.concat(F.lit('m'), F.col('id').cast('string')).alias('manifest'), F.lit('npm').alias('ecosystem'),
        F.when(F.col('id') % 2 == 0, 'p').otherwise('q').alias('name'), counted(parsed)(F.lit('1.5')).alias('version'))
    known = [(f'A{i}', 'npm', 'p', ['1.5'], [('1.1', None), ('0', '1.6'), (None, '1.2'), ('x', '1.9')], None, 's') for i in range(500)]
    advisories = spark.createDataFrame(known, 'id string, ecosystem string, name string, versions array<string>, ranges array<struct<introduced:string,'
                                       'fixed:string>>, severity array<struct<type:string,score:string>>, summary string')
    assert dependencies.advisories_for(deps_, advisories).count() == 2000 * 500
    assert parsed.value <= 4000 and 0 < keyed.value < 100


def test_risk_is_summed_without_making_the_hits(spark):
    found = [('r1', 'm', 'npm', 'p', v) for v in ['1.0'] * 300 + ['1.1', '*', 'odd']] + [('r2', 'm', 'npm', 'p', '1.1'), ('r3', 'm', 'npm', 'q', '1.0')]
    deps_ = spark.createDataFrame(found, 'repo string, manifest string, ecosystem string, name string, version string')
    known = [(f'A{i}', 'npm', 'p', ['1.0'], [('1.1', None)] if i % 3 else None, [('CVSS_V3', '9.8' if i % 2 else '4.5')], 's') for i in range(200)]
    advisories = spark.createDataFrame(known, 'id string, ecosystem string, name string, versions array<string>, ranges array<struct<introduced:string,'
                                       'fixed:string>>, severity array<struct<type:string,score:string>>, summary string')
    for some in (advisories, advisories.drop('ranges')):
        risk = dependencies.risk_by_repo(deps_, some)
        hits = Counter()
        for r in dependencies.advisories_for(deps_, some).collect():
            hits[r.repo] += {'CRITICAL': 10, 'MEDIUM': 2}[r.severity]
        assert {r.repo: r.dependency_risk for r in risk.collect()} == hits and hits['r1'] > 300 * 200
        plan = risk._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index('Join Inner'):]
        assert 'Aggregate [repo' in below and 'Aggregate [ecosystem' in below


def test_contents_are_decoded_in_small_batches(spark):
    rows = [(i, ('é' * 50).encode('latin-1') + b'x') for i in range(1200)]
    frame = spark.createDataFrame(rows, 'i int, content binary').coalesce(1)
    spark.conf.set('spark.sql.execution.arrow.maxRecordsPerBatch', '10000')
    text = sources.decode(frame)
    assert int(spark.conf.get('spark.sql.execution.arrow.maxRecordsPerBatch')) <= 500
    assert {(r.text, r.encoding) for r in text.collect()} == {('é' * 50 + 'x', 'latin-1')}
