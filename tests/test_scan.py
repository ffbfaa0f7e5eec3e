"""The scan against Python's re on generated texts."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codefindings.bindings import SNIPPETS
from codefindings.dims.rules import Rule, default_rules, enabled_rules
from codefindings.functions.text import UnsupportedPattern, java_pattern
from codefindings.operators import scan, structure

GLUE = ['\n', '\r\n', ' ', '\t', ' ', ' ', '\x1c', '\x85', 'é', 'ſ', 'İ', 'ı', 'K', '_', '²',
        '́', 'x', '"', "'", '(', ')', ';', '\x01', '$0', '\\']
LANGUAGES = ['python', 'javascript', 'java', 'php', 'c', 'cpp', 'Python', 'go', '']


def texts(n, seed=7):
    rng = random.Random(seed)
    pieces = [s for _, s in SNIPPETS] + ['paſſword = "x"', 'PASSWORD = "y"', 'tokeN', 'DELETE FROM a WHERE b + c',
                                         'eval\x1f(x)', 'éeval(x)', '_exec (y)', 'İNSERT into t VALUES +', 'ınsert into t  values +',
                                         'x²exec(', '́eval(']
    for i in range(n):
        text = ''.join(rng.choice(pieces + GLUE * 2) + rng.choice(GLUE + [''] * 8) for _ in range(rng.randint(0, 14)))
        yield f'f{i}', rng.choice(LANGUAGES), text


def brute(rule: Rule, text: str):
    flags = re.IGNORECASE if rule.ignore_case else 0
    for m in re.finditer(rule.pattern, text, flags):
        line = text.count('\n', 0, m.start()) + 1
        yield rule.rule_id, line, text.split('\n')[line - 1].strip()


def test_scan_equals_python(spark):
    rows = list(texts(700))
    want = Counter((path, *hit) for path, language, text in rows for rule in enabled_rules()
                   if rule.language in (None, language.lower()) for hit in brute(rule, text))
    files = spark.createDataFrame(rows, 'path string, language string, content string').repartition(4)
    got = Counter((r.path, r.rule_id, r.line_number, r.code_snippet) for r in scan.findings(files).collect())
    assert got == want
    assert len({k[1] for k in want}) == len(enabled_rules())


def test_counts_agree_with_findings(spark):
    files = spark.createDataFrame(list(texts(150, 3)), 'path string, language string, content string')
    counts = {r.path: r for r in scan.file_counts(files).collect()}
    assert len(counts) == 150
    found = scan.findings(files).collect()
    weights = {'CRITICAL': 10, 'HIGH': 5, 'MEDIUM': 2, 'LOW': 1}
    for path, row in counts.items():
        mine = [f for f in found if f.path == path]
        assert row.total == len(mine)
        assert row.critical == sum(f.severity == 'CRITICAL' for f in mine)
        assert row.score == sum(weights[f.severity] for f in mine)
        assert all(f.critical_issues == (row.critical > 0) for f in mine)


def test_many_matches_on_one_long_line(spark):
    text = ('a' * 32 + ' ') * 4000
    files = spark.createDataFrame([('f', 'go', text)], 'path string, language string, content string')
    hits = scan.hits(files).collect()
    assert [(h.rule_id, h.line_number, h.n_matches) for h in hits] == [(7, 1, 4000)]
    assert scan.per_match(scan.hits(files)).count() == 4000


def test_open_ended_rules_are_linear_in_the_line(spark):
    rules = [r for r in enabled_rules() if r.check == 'sql_injection']
    rows = [('never', 'go', 'select a from b ' * 330_000 + '+ where'), ('once', 'go', 'select ' * 200_000 + ' from x where + y')]
    files = spark.createDataFrame(rows, 'path string, language string, content string')
    start = time.time()
    assert [(h.path, h.line_number, h.n_matches) for h in scan.hits(files, rules).collect()] == [('once', 1, 1)]
    assert time.time() - start < 60


def test_open_ended_rules_equal_python(spark):
    rules = [r for r in enabled_rules() if r.check == 'sql_injection']
    rng = random.Random(5)
    words = ['SELECT', 'from', 'FROM', 'where', '+', 'a', '\n', ' ', 'insert', 'ınto', 'values', 'update', 'set', 'delete', '\x1c']
    rows = [(f'f{i}', 'go', ''.join(rng.choice(words) + rng.choice(['', ' ', '\n']) for _ in range(rng.randint(0, 60))))
            for i in range(1500)]
    want = Counter((path, *hit) for path, _, text in rows for rule in rules for hit in brute(rule, text))
    files = spark.createDataFrame(rows, 'path string, language string, content string').repartition(4)
    got = Counter((r.path, r.rule_id, r.line_number, r.code_snippet) for r in scan.findings(files, rules).collect())
    assert got == want and len(want) > 30


PATTERNS = [r'\bfoo\b', r'foo\b', r'\Bfoo', r'\d+', r'[^\d]x', r'\W+', r'\S+', r'[\W]a', r'a$', r'\Aa', r'o\Z', r'(?P<q>a)b(?P=q)',
            r'[a\]]+', r'x{2,3}?', r'(?:ab)+', r'(?=o)o', r'(?<!f)o', r'\.a', r'[\s\w]+', r'é\b', r'\bé', r'a|b', r'^b', r'(a)\1',
            r'[^\s]+', r'\x41', r'[]a]+', r'o\b.', r'\b', r'x?\B']


def test_foreign_patterns_equal_python(spark):
    rows = ['a foo b foobar xfoo', 'foo\n', 'é1 ٣ x', 'aba bab aa', '[a]&&xx xxx', 'oo foo', 'A.a\nb', 'é foo_ é', '', 'a\n', 'a]b[']
    df = spark.createDataFrame(list(enumerate(rows)), 'i int, t string')
    for pattern in PATTERNS:
        got = {r.i: r.m for r in df.select('i', F.regexp_extract_all('t', F.lit(java_pattern(pattern)), F.lit(0)).alias('m')).collect()}
        assert got == {i: [m[0] for m in re.finditer(pattern, t)] for i, t in enumerate(rows)}, pattern
    for pattern in (r'(?a)\w', r'(a)?(?(1)b|c)', r'[^\W]'):
        with pytest.raises(UnsupportedPattern):
            java_pattern(pattern)


def test_more_rules_than_one_plan_holds(spark):
    rules = [Rule(i, 'own', f'word{i}x', False, None, 'T', 'LOW', '', '', 0.5, (f'word{i}x',)) for i in range(1200)]
    files = spark.createDataFrame([('f', 'go', 'word7x\nword1199x word1199x')], 'path string, language string, content string')
    assert sorted((h.rule_id, h.n_matches) for h in scan.hits(files, rules).collect()) == [(7, 1), (1199, 2)]


def test_critical_flag_knows_all_rules(spark):
    rules = [Rule(i, 'own', f'word{i}x', False, None, 'T', 'CRITICAL' if i == 501 else 'LOW', '', '', 0.5, (f'word{i}x',))
             for i in range(1, 502)]
    rows = [('both', 'go', 'word1x\nword501x'), ('one', 'go', 'word1x')]
    files = spark.createDataFrame(rows, 'path string, language string, content string')
    assert sorted((h.path, h.rule_id, h.critical_issues) for h in scan.hits(files, rules).collect()) == [
        ('both', 1, True), ('both', 501, True), ('one', 1, False)]
    assert {r.path: (r.total, r.critical) for r in scan.file_counts(files, rules).collect()} == {'both': (2, 1), 'one': (1, 0)}
    assert [r.path for r in scan.without_critical(files, rules).collect()] == ['one']


def test_literals_that_begin_and_hold_others(spark):
    words = ['pass', 'password', 'word', 'sword', 'wo', 'a.b', 'a|b', 'é', '(', 'ss', 'x y', '\t\n']
    rules = [Rule(i, 'own', re.escape(w), False, None, 'T', 'LOW', '', '', 0.5, (w,)) for i, w in enumerate(words)]
    rules.append(Rule(99, 'own', 'p', False, None, 'T', 'LOW', '', '', 0.5, ('pass', 'a.b', '')))
    rng = random.Random(1)
    rows = [(f'f{i}', 'go', ''.join(rng.choice(words + ['p', 'as', 'wor', 'd', 'a', '.', 'b', ' ']) for _ in range(rng.randrange(6))))
            for i in range(300)]
    files = spark.createDataFrame(rows, 'path string, language string, content string')
    got = {r.path: sorted(r.may) for r in files.select(
        'path', scan.candidates(rules, F.col('content'), F.col('language')).alias('may')).collect()}
    assert got == {p: [r.rule_id for r in rules if all(n in t for n in r.needles)] for p, _, t in rows}


def test_contents_do_not_leave_the_jvm(spark):
    files = spark.createDataFrame(list(texts(5)), 'path string, language string, content string').withColumn('other', F.lit(1))
    plan = scan.findings(files)._jdf.queryExecution().executedPlan().toString()
    assert 'MapInArrow' not in plan
    handed, = re.findall(r'ArrowEvalPython \[places\((CASE WHEN arrays_overlap.*? END), (CASE WHEN arrays_overlap.*? END)\)', plan)
    assert not any('ELSE' in x for x in handed)


def test_literals_are_looked_for_once(spark):
    files = spark.createDataFrame(list(texts(5)), 'path string, language string, content string')
    for rules in (enabled_rules(), [r for r in enabled_rules() if r.check == 'xss']):
        plan = scan.file_counts(files, rules)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count('regexp_extract_all') == 1


def test_empty_and_null_files(spark):
    files = spark.createDataFrame([('a', 'python', ''), ('b', None, None), ('c', None, '../')],
                                  'path string, language string, content string')
    assert [(r.path, r.rule_id) for r in scan.findings(files).select('path', 'rule_id').collect()] == [('c', 63)]
    assert scan.file_counts(files.filter("path = 'a'")).collect()[0].total == 0


def test_rules_from_table(spark):
    table = spark.createDataFrame([tuple(r) for r in default_rules()[:3]], (
        'rule_id int, check string, pattern string, ignore_case boolean, language string, '
        'vulnerability_type string, severity string, description string, fix_suggestion string, '
        'confidence double, needles array<string>, enabled boolean'))
    assert sorted(scan.rules_from(table)) == sorted(default_rules()[:3])


def test_rule_table():
    assert len(default_rules()) == 79 and len(enabled_rules()) == 75
    for rule in default_rules():
        assert re.compile(rule.pattern) and java_pattern(rule.pattern, rule.ignore_case)


def test_imports_equal_python(spark):
    rows = [(p, t) for p, _, t in texts(400, 11)]
    files = spark.createDataFrame(rows, 'path string, content string')
    got = files.select('path', structure.python_imports(files.content).alias('py'),
                       structure.js_imports(files.content).alias('js')).collect()
    by_path = dict(rows)
    for row in got:
        text = by_path[row.path]
        py = {(a or b).split('.')[0] for a, b in re.findall(structure.PY_IMPORT_LINE, text, re.M)}
        js = set(re.findall(structure.JS_IMPORT, text)) | set(re.findall(structure.JS_REQUIRE, text))
        assert (row.py, row.js) == (sorted(py), sorted(js))


def test_captures_equal_python(spark):
    rows = [(p, t) for p, _, t in texts(300, 5)]
    files = spark.createDataFrame(rows, 'path string, content string')
    got = Counter((r.path, r.name, r.line_start) for r in structure.js_functions(files).collect())
    want = Counter((p, next(g for g in m.groups() if g), t.count('\n', 0, m.start()) + 1)
                   for p, t in rows for m in re.finditer(structure.JS_FUNCTION, t))
    assert got == want


def test_runs_and_words_are_tried_where_they_begin(spark):
    run = [r for r in enabled_rules() if scan.run_test(r)]
    assert [r.pattern for r in run] == ['[a-zA-Z0-9]{32,}']
    texts = ['x' * 31, 'é' + 'A1' * 16 + '!', 'ſK' + 'a' * 30, 'a' * 20 + '_' + 'a' * 20, 'zz ' + 'b' * 40 + '\n' + 'c' * 64, '', None]
    files = spark.createDataFrame([(str(i), 'go', t) for i, t in enumerate(texts)], 'path string, language string, content string')
    may = {r.path: r.may for r in files.select('path', scan.candidates(run, F.col('content'), F.col('language')).alias('may')).collect()}
    assert [p for p, ids in may.items() if ids] == ['1', '2', '4']
    assert sorted((r.path, r.line_number) for r in scan.findings(files, run).collect()) == [('1', 1), ('2', 1), ('4', 1), ('4', 2)]
    assert java_pattern(r'\beval').startswith('(?d)(?=e)') and '(?=' not in java_pattern(r'\bx?y')
