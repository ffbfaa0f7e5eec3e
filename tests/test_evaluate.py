"""Matching against a plain greedy loop, and the known evaluation result."""

import random

import pytest

from codefindings.functions import risk
from codefindings.operators import aggregate, evaluate

GOLDEN = [('sql_injection.py', 9, 'SQL_INJECTION', 'HIGH'), ('hardcoded_secrets.py', 5, 'HARDCODED_SECRETS', 'CRITICAL'),
          ('hardcoded_secrets.py', 6, 'HARDCODED_SECRETS', 'CRITICAL'), ('command_injection.py', 8, 'COMMAND_INJECTION', 'HIGH'),
          ('command_injection.py', 11, 'COMMAND_INJECTION', 'HIGH'), ('weak_crypto.py', 7, 'WEAK_CRYPTO', 'HIGH'),
          ('weak_crypto.py', 13, 'WEAK_RANDOM', 'MEDIUM'), ('insecure_deserialization.py', 7, 'INSECURE_DESERIALIZATION', 'HIGH'),
          ('insecure_deserialization.py', 12, 'INSECURE_DESERIALIZATION', 'CRITICAL')]
SCHEMA = 'file string, type string, line long, ord long'


def agrees(p, g):
    return ((p[0].endswith(g[0]) or g[0].endswith(p[0])) and p[1].strip().upper() == g[1].strip().upper()
            and abs(p[2] - g[2]) <= 1)


def greedy(preds, truth):
    used, pairs = set(), {}
    for i, p in enumerate(preds):
        for j, g in enumerate(truth):
            if j not in used and agrees(p, g):
                used.add(j)
                pairs[i] = j
                break
    return pairs


def frames(spark, preds, truth):
    return (spark.createDataFrame([(*p, i) for i, p in enumerate(preds)], SCHEMA),
            spark.createDataFrame([(*g, i) for i, g in enumerate(truth)], SCHEMA))


def check(spark, preds, truth):
    p, g = frames(spark, preds, truth)
    assert {r.ord: r.truth_ord for r in evaluate.match(p, g).collect()} == greedy(preds, truth)
    free = {i for i, x in enumerate(preds) if not any(agrees(x, y) for y in truth)}
    assert {r.ord for r in evaluate.unmatched(p, g).collect()} == free


def test_random_cases_equal_greedy(spark):
    # Independent cases share one run: the type keeps them apart.
    rng = random.Random(3)
    preds, truth = [], []
    for case in range(120):
        names = rng.sample(['a.py', 'xa.py', 'b.py', 'yb.py', 'py'], rng.randint(1, 3))
        for _ in range(rng.randint(0, 8)):
            preds.append((rng.choice(names), f' t{case} ', rng.randint(1, 5)))
        for _ in range(rng.randint(0, 7)):
            truth.append((rng.choice(names), f'T{case}', rng.randint(1, 5)))
    rng.shuffle(preds)
    rng.shuffle(truth)
    check(spark, preds, truth)


@pytest.mark.parametrize('most', [200_000, 30])
def test_long_chains_and_large_islands_equal_greedy(spark, monkeypatch, most):
    monkeypatch.setattr(evaluate, 'ISLAND_ROWS', most)
    rng = random.Random(8)
    n = 10_000 if most > 1000 else 60
    preds = [(rng.choice(['a.py', 'src/a.py']), 'X', i + rng.choice([0, 0, 1])) for i in range(n)]
    truth = [('a.py', 'x ', i) for i in range(1, n)] + [('b.py', 'X', 7)]
    preds += [('b.py', 'X', 7), ('b.py', 'X', 900), (None, 'X', 1), ('b.py', None, 7), ('b.py', 'X', None)]
    if most < 1000:
        rng.shuffle(preds)
        rng.shuffle(truth)
    used, by_line, want = set(), {}, {}
    for j, g in enumerate(truth):
        by_line.setdefault(g[2], []).append(j)
    for i, p in enumerate(preds):
        near = sorted(j for d in (-1, 0, 1) for j in by_line.get(p[2] + d, ())) if None not in p else ()
        free = [j for j in near if j not in used and agrees(p, truth[j])]
        if free:
            used.add(free[0])
            want[i] = free[0]
    p, g = frames(spark, preds, truth)
    assert {r.ord: r.truth_ord for r in evaluate.match(p, g).collect()} == want and len(want) > n / 2


def test_islands_are_dealt_by_a_shuffle_of_their_own(spark, capsys):
    # Without it the rows come straight from the join with the sizes, which Spark may read by mapper at run time.
    evaluate.match(*frames(spark, [('a.py', 'X', 5)], [('a.py', 'X', 5)])).explain()
    plan = capsys.readouterr().out
    assert 'MapInArrow _greedy' in plan and 'REPARTITION_BY_NUM' in plan


def test_hot_place(spark):
    preds = [('a.py', 'X', 5)] * 60 + [('a.py', 'X', 6)] * 10
    check(spark, preds, [('a.py', 'X', 5)] * 40)


def test_golden_result(spark):
    rows = [(f, t, n) for f, n, t, _ in GOLDEN]
    p, g = frames(spark, rows, rows)
    m = evaluate.metrics(p, g, evaluate.match(p, g)).collect()[0]
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.f1) == (9, 0, 0, 1.0, 1.0, 1.0)
    found = spark.createDataFrame(GOLDEN, 'path string, line_number int, vulnerability_type string, severity string')
    row = aggregate.by_severity(found).withColumns({
        'report': risk.report_score(), 'dash': risk.dashboard_score(), 'l1': risk.ladder('codebase'),
        'l2': risk.ladder('repository')}).collect()[0]
    assert (row.critical, row.high, row.medium, row.report, row.dash, row.l1, row.l2) == (3, 5, 1, 100, 228, 'CRITICAL', 'CRITICAL')
    assert aggregate.file_scores(found).collect()[0].score == 57


def test_empty_inputs(spark):
    p, g = frames(spark, [('a.py', 'X', 5)], [('a.py', 'X', 5)])
    for preds, truth, want in [(p.limit(0), g, (0, 0, 1)), (p, g.limit(0), (0, 1, 0)), (p.limit(0), g.limit(0), (0, 0, 0))]:
        m = evaluate.metrics(preds, truth, evaluate.match(preds, truth)).collect()[0]
        assert (m.tp, m.fp, m.fn) == want and m.f1 == 0.0
