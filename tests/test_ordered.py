"""Distributed order-dependent columns against plain Python, with one key holding most rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from codefindings.operators import ordered, ranking


def keyed(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(['hot'] * 6 + ['a', 'b', None]), i, rng.randint(1, 9)) for i in rng.sample(range(10 * n), n)]


def test_running_sum_and_position(spark):
    rows = keyed(3000, 1)
    df = spark.createDataFrame(rows, 'k string, o long, v long').repartition(5)
    got = {(r.k, r.o): r.s for r in ordered.running_sum(df, ['k'], ['o'], F.col('v'), 's').collect()}
    nth = {(r.k, r.o): r.p for r in ordered.position(df, ['k'], [F.desc('o')], 'p').collect()}
    groups = defaultdict(list)
    for k, o, v in rows:
        groups[k].append((o, v))
    for k, items in groups.items():
        items.sort()
        total = 0
        for i, (o, v) in enumerate(items):
            total += v
            assert got[k, o] == total and nth[k, o] == len(items) - i
    assert len(got) == len(rows)


def test_running_sum_spreads_a_hot_key(spark):
    df = spark.range(4000).select(F.lit('hot').alias('k'), F.col('id').alias('o'))
    sliced = df.repartitionByRange(4, 'k', 'o').groupBy(F.spark_partition_id()).count().collect()
    assert len(sliced) == 4 and max(r['count'] for r in sliced) < 2000


def test_time_windows(spark):
    rng = random.Random(4)
    times = sorted(rng.sample(range(600_000_000), 400)) + [700_000_000, 760_000_000, 760_000_001, 8_000_000_000]
    rows = [(rng.choice(['hot', 'hot', 'x']), t) for t in times] + [('hot', 5_000_000_000), ('x', 5_000_000_000)] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], 'i int, k string, us long')
    counts = {r.i: r.n for r in ordered.count_before(df, ['k'], 'us', 60_000_000, 'n').collect()}
    before = {r.i: r.p for r in ordered.previous(df, ['k'], 'us', 'p', bucket=50_000_000).collect()}
    for i, (k, t) in enumerate(rows):
        assert counts[i] == sum(k2 == k and t - 60_000_000 < t2 < t for k2, t2 in rows)
    for k in ('hot', 'x'):
        ts = sorted(t for k2, t in rows if k2 == k)
        got = sorted(((t, before[i]) for i, (k2, t) in enumerate(rows) if k2 == k), key=lambda x: (x[0], x[1] or -1))
        assert got == [(t, ts[j - 1] if j else None) for j, t in enumerate(ts)]
    assert len(counts) == len(before) == len(rows)


def test_exactly_sixty_seconds_ago_does_not_count(spark):
    df = spark.sql("SELECT id AS request_id, 'k' AS key, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0, id * 60) AS ts FROM range(3)")
    assert {r.in_last_minute for r in ranking.request_rate(df).collect()} == {0}


def test_group_limit_is_applied_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col('id') % 3).alias('repo_id'), F.col('id').alias('ord'),
                                  F.lit('2024-01-01').cast('timestamp_ntz').alias('ts'))
    plan = ranking.recent_history(df, ['repo_id'])._jdf.queryExecution().toString()
    assert 'WindowGroupLimit' in plan and 'Partial' in plan


def test_equal_times_follow_each_other_by_id(spark):
    rows = [(i, 'k', 10_000_000 * (i // 3)) for i in range(9)]
    want = {i: None if i == 0 else (0 if i % 3 else 10_000_000) for i, _, _ in rows}
    for seed in range(3):
        shuffled = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(shuffled, 'request_id long, key string, us long').select(
            'request_id', 'key', F.timestamp_micros('us').cast('timestamp_ntz').alias('ts'))
        assert {r.request_id: r.gap_us for r in ranking.request_gap(df).collect()} == want
