"""Pattern scan: files -> findings.

One narrow pass over the files, without any shuffle or join: the rule table travels inside the plan
as a literal array. One pattern made of all rules' literals, looked for once in a text, tells which of
them it holds; only rules that have all of theirs run their own pattern. Line numbers come from
inserting one mark in front of every match and comparing line lengths, so the work stays linear in the
text however many matches it has.

Patterns with several open-ended parts could make a backtracking engine retry without end on one long
line. They are matched by Arrow's engine, which is linear in the text. It is handed one column, which is
NULL for all texts but those that hold all literals of such a rule, and returns places only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from codefindings.dims.rules import Rule, enabled_rules
from codefindings.dims.severity import RISK_WEIGHTS, SEVERITIES
from codefindings.functions.text import (SPACE, UnsupportedPattern, bind, java_pattern, lines, rows_of, strip,
                                         translated)

METHOD = 'static_pattern'
PLACES = 'array<struct<rule_id:bigint,line_number:bigint,n_matches:int>>'
#: Rules per array literal; the literals are concatenated when the plan is made.
RULES_PER_LITERAL = 500


def rules_from(df: DataFrame) -> list[Rule]:
    """Read a user's rule table (columns as in :class:`Rule`). Every rule counts, there is no limit."""
    return [Rule(**{**row.asDict(), 'needles': tuple(row['needles'] or ())}) for row in df.toLocalIterator()]


def _sql(value) -> str:
    """A value as a Spark SQL literal."""
    if value is None:
        return 'CAST(NULL AS STRING)'
    if isinstance(value, str):
        return "'" + value.replace('\\', '\\\\').replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f'{value!r}D'
    if isinstance(value, (list, tuple)):
        return 'CAST(array(' + ', '.join(map(_sql, value)) + ') AS ARRAY<STRING>)'
    return str(value)


def literal_array(values: Iterable[str]) -> Column:
    """An array of SQL literals, however many. Folds to one literal."""
    values = list(values)
    return F.concat(*[F.expr('array(' + ', '.join(values[i:i + RULES_PER_LITERAL]) + ')')
                      for i in range(0, len(values), RULES_PER_LITERAL)])


def rule_array(rules: Iterable[Rule], **fields) -> Column:
    """The rules as an array of structs; ``fields`` name functions of a rule."""
    return literal_array('named_struct(' + ', '.join(f"'{name}', {_sql(of(r))}" for name, of in fields.items()) + ')'
                         for r in rules)


def _descriptions(rules: Iterable[Rule]) -> Column:
    return rule_array(rules, check_name=lambda r: r.check, vulnerability_type=lambda r: r.vulnerability_type,
                      severity=lambda r: r.severity, description=lambda r: r.description,
                      fix_suggestion=lambda r: r.fix_suggestion, confidence=lambda r: r.confidence)


# Non-ASCII characters that equal i, i, s, k when case is ignored.
_FOLDING = ('\u0130\u0131\u017f\u212a', 'iisk')


def folded(text: Column) -> Column:
    """Text in which every character that equals an ASCII letter ignoring case is that letter."""
    some = reduce(or_, [F.contains(text, F.lit(c)) for c in _FOLDING[0]])
    return F.lower(F.when(some, F.translate(text, *_FOLDING)).otherwise(text))


def run_test(rule: Rule) -> str | None:
    """For a rule that is nothing but a run of ASCII letters and digits: what a folded text it matches holds, else None.

    A run is tried from its beginning only. The rule's own pattern tries it from each of its characters.
    """
    shape = re.fullmatch(r'\[((?:a-z|A-Z|0-9)+)\]\{(\d+)(?:,\d*)?\}', rule.pattern)
    if not shape or not rule.ignore_case or not re.search('[a-zA-Z]', shape[1]):
        return None
    kind = shape[1].lower()
    return f'(?<![{kind}])[{kind}]{{{shape[2]}}}'


def match_counts(text: Column, pattern: Column, text_lines: Column | None = None) -> Column:
    """Array with the number of matches starting on each line."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit('\x01$0')), '\n', -1)
    return F.zip_with(lines(text) if text_lines is None else text_lines, marked, lambda plain, mark: F.length(mark) - F.length(plain))


def _hits_of(text: Column, rule: Column, text_lines: Column) -> Column:
    numbered = F.transform(match_counts(text, rule['pattern'], text_lines), lambda n, i: F.struct(
        (i + 1).alias('line_number'), n.alias('n_matches')))
    return F.transform(F.filter(numbered, lambda x: x['n_matches'] > 0), lambda x: F.struct(
        rule['rule_id'].alias('rule_id'), x['line_number'].cast('bigint').alias('line_number'),
        x['n_matches'].alias('n_matches'),
        strip(F.element_at(text_lines, x['line_number'])).alias('code_snippet')))


def open_ended(rule: Rule) -> bool:
    """Several parts of the pattern may take any number of characters."""
    return len(re.findall(r'\.[*+]', rule.pattern)) > 1


def linear_pattern(rule: Rule) -> str:
    """The rule's pattern in the syntax of Arrow's engine; raises for what that engine lacks."""
    if re.search(r'\\[bBdDSWZ0-9]|\(\?[^:]|[*+?}][+]', rule.pattern):
        raise UnsupportedPattern(rule.pattern)
    flags = '(?i)' if rule.ignore_case else ''
    return flags + translated(rule.pattern, {r'\s': f'[{SPACE}]', r'\w': r'[\p{L}\p{N}_]'},
                              {r'\s': SPACE, r'\w': r'\p{L}\p{N}_'})


def _is_linear(rule: Rule) -> bool:
    try:
        return open_ended(rule) and bool(linear_pattern(rule))
    except UnsupportedPattern:
        return False


def any_of(words: Iterable[str]) -> str:
    """A pattern that matches, without taking characters, where one of ``words`` starts; group 1 is the longest.

    Common beginnings are written once, so the work per character hardly grows with the words.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[''] = {}

    def written(node: dict) -> str:
        ways = [(c if c.isalnum() else f'\\x{{{ord(c):x}}}') + written(rest) for c, rest in sorted(node.items()) if c]
        if not ways:
            return ''
        return f'(?:{"|".join(ways)})' + ('?' if '' in node else '') if '' in node or len(ways) > 1 else ways[0]
    return f'(?=({written(tree)}))'


class Literals:
    """The literals of some rules. Single characters are looked for one by one: they occur everywhere."""

    def __init__(self, rules: Iterable[Rule]):
        every = {n for r in rules for n in r.needles if n}
        self.words = sorted(n for n in every if len(n) > 1)
        self.characters = sorted(n for n in every if len(n) == 1)

    def held(self, low: Column) -> Column:
        """The literals found in a folded text: of several starting at one place, the longest."""
        none = F.expr('CAST(array() AS array<string>)')
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(any_of(self.words)), F.lit(1))) if self.words else none
        found = F.filter(F.array(*map(F.lit, self.characters)), lambda c: F.contains(low, c)) if self.characters else none
        return F.concat(words, found)

    def ways(self, needle: str) -> list[str]:
        """The literals that show that ``needle`` occurs: those that start with it."""
        return [w for w in self.words if w.startswith(needle)] if len(needle) > 1 else [needle]


def candidates(rules: list[Rule], text: Column, language: Column) -> Column:
    """The ids of the rules of the file's language all of whose literals, or whose run, the text holds."""
    literals = Literals(rules)
    tests = rule_array(rules, rule_id=lambda r: r.rule_id, language=lambda r: r.language)
    groups = literal_array('CAST(array(' + ', '.join(map(_sql, (literals.ways(n) for n in r.needles if n))) + ') AS array<array<string>>)'
                           for r in rules)

    runs: dict[str, list[int]] = {}
    for r in rules:
        if run_test(r):
            runs.setdefault(run_test(r), []).append(r.rule_id)

    def those(low):
        def of(held):
            may = F.zip_with(tests, groups, lambda r, ways: F.when(
                (r['language'].isNull() | (r['language'] == F.lower(language)))
                & F.forall(ways, lambda some: F.arrays_overlap(held, some)), r['rule_id']))
            found = F.filter(may, lambda i: i.isNotNull())
            for pattern, ids in runs.items():
                found = F.when(F.rlike(low, F.lit(pattern)), found).otherwise(F.array_except(found, literal_array(map(str, ids))))
            return found
        return bind(literals.held(low), of)
    return bind(folded(text), those)


def _places_of(rules: list[Rule]):
    """An Arrow function of (content or NULL, candidate ids): the places at which open-ended rules match."""
    wanted = [(r.rule_id, linear_pattern(r), r.ignore_case) for r in rules]

    @F.arrow_udf(PLACES)
    def places(content: pa.Array, may: pa.Array) -> pa.Array:
        found: list[list] = [[] for _ in range(len(content))]
        given = np.flatnonzero(content.is_valid().to_numpy(zero_copy_only=False))
        texts = content.take(pa.array(given)).cast(pa.large_string())
        ids = [set(x) for x in may.take(pa.array(given)).to_pylist()]
        plain = texts
        for one, other in zip(*_FOLDING):
            plain = pc.replace_substring(plain, one, other)
        for rule_id, pattern, ignore_case in wanted:
            at = pa.array([i for i, some in enumerate(ids) if rule_id in some], pa.int64())
            before = (plain if ignore_case else texts).take(at)
            marked = pc.replace_substring_regex(before, pattern, '\x01\\0')
            longer = pc.not_equal(pc.binary_length(marked), pc.binary_length(before))
            for i, a, b in zip(*(x.filter(longer).to_pylist() for x in (at, before, marked))):
                found[given[i]] += [(rule_id, n, len(y) - len(x)) for n, (x, y) in
                                    enumerate(zip(a.split('\n'), b.split('\n')), 1) if len(x) != len(y)]
        kind = pa.list_(pa.struct([('rule_id', pa.int64()), ('line_number', pa.int64()), ('n_matches', pa.int32())]))
        return pa.array([[dict(zip(('rule_id', 'line_number', 'n_matches'), x)) for x in some] or None for some in found], kind)
    return places


def _per_file(files: DataFrame, rules: list[Rule], keep: Iterable[str]) -> DataFrame:
    """``keep`` plus ``hits``: all (rule, line) places of one file as an array."""
    linear = [r for r in rules if _is_linear(r)]
    usual = [r for r in rules if r not in linear]
    text = F.col('content')
    hits = F.expr('CAST(array() AS array<struct<rule_id:int,line_number:bigint,n_matches:int,code_snippet:string>>)')
    if not rules:
        return files.select(*keep, hits.alias('hits'))
    may = candidates(rules, text, F.col('language'))
    if usual:
        patterns = rule_array(usual, rule_id=lambda r: r.rule_id, pattern=lambda r: java_pattern(r.pattern, r.ignore_case))

        def found(ids):
            wanted = F.filter(patterns, lambda r: F.array_contains(ids, r['rule_id']) & F.rlike(text, r['pattern']))
            return bind(wanted, lambda some: F.when(F.size(some) == 0, hits).otherwise(bind(lines(text), lambda text_lines: F.flatten(
                F.transform(some, lambda r: _hits_of(text, r, text_lines))))))
        # Bound, as the optimizer would put a column's expression into the filter, once per rule.
        matched = bind(F.col('_may') if linear else may, found)
    else:
        matched = hits
    if not linear:
        return files.select(*keep, matched.alias('hits'))
    tried = files.select(*dict.fromkeys([*keep, 'content']), may.alias('_may'))
    some = F.arrays_overlap('_may', literal_array(str(r.rule_id) for r in linear))
    tried = tried.withColumn('_places', _places_of(linear)(F.when(some, text), F.when(some, F.col('_may'))))
    more = bind(lines(text), lambda text_lines: F.transform('_places', lambda p: F.struct(
        p['rule_id'].cast('int').alias('rule_id'), p['line_number'].alias('line_number'), p['n_matches'].alias('n_matches'),
        strip(F.element_at(text_lines, p['line_number'].cast('int'))).alias('code_snippet'))))
    return tried.select(*keep, F.when(F.col('_places').isNull(), matched).otherwise(F.concat(matched, more)).alias('hits'))


def hits(files: DataFrame, rules: Iterable[Rule] | None = None, keep: Iterable[str] = ('path',)) -> DataFrame:
    """One row per (file, rule, line) with the number of matches starting there.

    ``files`` needs ``language`` and ``content``. This is the compact form: a line's text is stored
    once, however often a rule matches on it. ``critical_issues`` tells whether the file has any
    CRITICAL finding, whatever the number of rules; it is worked out inside the file's row.
    """
    rules = list(enabled_rules() if rules is None else rules)
    critical = literal_array(str(r.rule_id) for r in rules if r.severity == 'CRITICAL') \
        if any(r.severity == 'CRITICAL' for r in rules) else None
    has_critical = F.lit(False) if critical is None else F.exists('hits', lambda h: F.array_contains(critical, h['rule_id']))
    place = F.array_position(literal_array(str(r.rule_id) for r in rules), F.col('hit.rule_id')).cast('int')
    rule = F.element_at(_descriptions(rules), place)
    flagged = _per_file(files, rules, keep).withColumn('critical_issues', has_critical)
    return (rows_of(flagged, [*keep, 'critical_issues'], F.col('hits'), 'hit')
            .select(*keep, 'critical_issues', 'hit.*', rule.alias('rule'))
            .select(*keep, 'rule_id', 'line_number', 'n_matches', 'code_snippet', 'critical_issues',
                    'rule.check_name', 'rule.vulnerability_type', 'rule.severity',
                    'rule.description', 'rule.fix_suggestion', 'rule.confidence',
                    F.lit(METHOD).alias('detection_method')))


def file_counts(files: DataFrame, rules: Iterable[Rule] | None = None,
                keep: Iterable[str] = ('path',)) -> DataFrame:
    """One row per file, clean files included: total, critical … info and the risk score.

    Counted inside the row: no explode, no shuffle.
    """
    rules = list(enabled_rules() if rules is None else rules)

    names = [s.lower() for s in SEVERITIES]
    kinds = rule_array(rules, severity=lambda r: r.severity.upper(), weight=lambda r: RISK_WEIGHTS.get(r.severity.upper(), 1)) \
        if rules else None
    place = literal_array(str(r.rule_id) for r in rules) if rules else None
    zero = F.lit(0).cast('bigint')
    start = F.struct(*[zero.alias(n) for n in ['total', *names, 'score']])

    def add(sums, hit):
        def of(kind):
            n = hit['n_matches'].cast('bigint')
            return F.struct((sums['total'] + n).alias('total'),
                            *[(sums[s.lower()] + F.when(kind['severity'] == s, n).otherwise(zero)).alias(s.lower())
                              for s in SEVERITIES],
                            (sums['score'] + n * kind['weight']).alias('score'))
        return bind(F.element_at(kinds, F.array_position(place, hit['rule_id']).cast('int')), of)

    counts = F.aggregate('hits', start, add) if rules else start
    return _per_file(files, rules, keep).withColumn('_counts', counts).select(*keep, '_counts.*')


def without_critical(files: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """The files in which no critical rule matches: a filter in the row, nothing is joined."""
    critical = [r for r in (enabled_rules() if rules is None else rules) if r.severity == 'CRITICAL']
    return _per_file(files, critical, files.columns).filter(F.size('hits') == 0).drop('hits')


def per_match(found: DataFrame) -> DataFrame:
    """One row per match; ``occurrence`` numbers the matches of a rule on one line from 1."""
    return (found.withColumn('occurrence', F.explode(F.sequence(F.lit(1), F.col('n_matches'))))
            .drop('n_matches'))


def findings(files: DataFrame, rules: Iterable[Rule] | None = None,
             keep: Iterable[str] = ('path',)) -> DataFrame:
    """All findings, one row per match. Order them by rule_id, line_number, occurrence."""
    return per_match(hits(files, rules, keep))


def captured(text: Column, pattern: str, groups: int) -> Column:
    """Array of (line_number, g1 … gN), one per match in order; NULL without a match."""
    java = java_pattern(pattern)

    def per_file(counts):
        start_lines = F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i + 1, n)))
        parts = [start_lines.alias('line_number')] + [
            F.regexp_extract_all(text, F.lit(java), F.lit(g)).alias(f'g{g}')
            for g in range(1, groups + 1)]
        return F.arrays_zip(*parts)
    return F.when(text.rlike(java), bind(match_counts(text, F.lit(java)), per_file))


def capture(files: DataFrame, pattern: str, groups: int, keep: Iterable[str] = ('path',)) -> DataFrame:
    """Start line and captured groups of every match of one pattern.

    Returns ``keep``, ``line_number``, ``ord`` (match order within the file) and ``g1`` … ``gN``
    ('' for a group that took no part).
    """
    return (rows_of(files, keep, captured(F.col('content'), pattern, groups), 'm', 'pos')
            .select(*keep, F.col('m.line_number').alias('line_number'),
                    (F.col('pos') + 1).alias('ord'),
                    *[F.col(f'm.g{g}').alias(f'g{g}') for g in range(1, groups + 1)]))
