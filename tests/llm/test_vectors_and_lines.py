"""Line dedup, hard negatives and centroid clustering against plain versions and SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codefindings.llm import centroids, common, linededup, negatives
from tests.llm import cases

VECTORS = 'vec_id long, embedding array<float>, label int, score double, slot long, vector int, rank int'


# ---- line dedup ----------------------------------------------------------------------------
def plain_key(line):
    return line.strip(' \t\n\x0b\x0c\r').translate(str.maketrans(linededup.UPPER, linededup.LOWER))


def plain_dedup(rows, least=10):
    lines = [(i, (t or '').split('\n')) for i, t in rows]
    seen = Counter(k for _, some in lines for k in {plain_key(x) for x in some} if k)
    out = []
    for i, some in lines:
        kept = [x for x in some if not plain_key(x) or seen[plain_key(x)] < least]
        out.append((i, len(some), len(some) - len(kept), hashlib.sha256('\n'.join(kept).encode()).hexdigest()))
    return out


def line_rows():
    rng = random.Random(3)
    rows = [(i, '\n'.join(rng.choice(['Footer  here', ' footer  HERE\t', 'ÄRGER', 'ärger', f'own {i}', '', '  ', 'a\rb', 'twice'])
                          for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(1000 + i, 'SAME line\n' * 200 + f'x{i}') for i in range(12)]
    rows += [(None, 'nameless\nfooter  here')] * 9 + [(7, 'nameless')] + [(None, None), (None, None), (3, ''), (4, 'x' * 50000)]
    return rows + [(2000 + i, '\n'.join(f'l{j}' for j in range(64 * i, 64 * i + 300)) + '\nFOOTER  here') for i in range(3)]


def deduped(frame, least=10):
    found = linededup.without_shared_lines(frame, linededup.keep_bitmaps(frame, least))
    return [tuple(r) for r in found.select('doc_id', 'n_lines', 'n_dropped', F.sha2('text', 256)).collect()]


@pytest.mark.parametrize('least', [1, 2, 10, 500])
def test_lines_equal_plain_version(spark, least):
    frame = spark.createDataFrame(line_rows(), 'doc_id long, text string').repartition(5)
    assert sorted(map(str, deduped(frame, least))) == sorted(map(str, plain_dedup(line_rows(), least)))


def test_lines_of_odd_rows(spark):
    want = plain_dedup([(r[0], r[1]) for r in cases.rows()], 2)
    assert sorted(map(str, deduped(cases.frame(spark), 2))) == sorted(map(str, want))
    assert deduped(cases.empty(spark)) == []


def test_keep_lead_leaves_the_first_line(spark):
    rows = [(3, 'a\nb\na'), (1, 'c\nA'), (2, 'a')]
    frame = spark.createDataFrame(rows, 'doc_id long, text string').repartition(3)
    bitmaps = linededup.keep_bitmaps(frame, 2, keep_lead=True)
    texts = {r.doc_id: r.text for r in linededup.without_shared_lines(frame, bitmaps).collect()}
    assert texts == {3: 'b', 1: 'c\nA', 2: ''}


def test_bitmaps_leave_out_words_that_keep_all(spark):
    rows = [(i, '\n'.join(f'{i} {j}' for j in range(1000)) + '\nend') for i in range(3)]
    bitmaps = linededup.keep_bitmaps(spark.createDataFrame(rows, 'doc_id long, text string'), 3)
    kept = [r.keep for r in bitmaps.collect()]
    assert [[(w.word, w.bits) for w in k] for k in kept] == [[(1000 // 64, ~(1 << 1000 % 64))]] * 3


def test_lines_stay_in_the_jvm_and_are_dealt_by_range(spark, sf):
    frame = common.documents(spark, sf)
    plan = linededup.occurrences(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count('Exchange') == 1 and 'rangepartitioning(hash' in plan
    whole = linededup.op11_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 'Python' not in whole and 'Arrow' not in whole


def test_join_by_key_meets_heavy_and_light_keys(spark):
    rows = spark.range(20000).select(F.when(F.col('id') % 3 == 0, 0).otherwise(F.col('id')).alias('k'), 'id')
    keyed = rows.groupBy(F.col('k').alias('_k')).agg(F.count(F.lit(1)).alias('n')).filter('_k % 2 = 0')
    got = {r.k: r.c for r in common.join_by_key(rows, keyed, 'k', '_k', 'n').groupBy('k').agg(F.count(F.lit(1)).alias('c')).collect()}
    assert got == {r._k: r.n for r in keyed.collect()}
    assert common.join_by_key(rows, keyed.limit(0), 'k', '_k', 'n').count() == 0


# ---- hard negatives ------------------------------------------------------------------------
def plain_negatives(rows, anchor, positives=5, count=10, scale=256):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v], n) for i, v, n in rows
             if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, n in whole:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in whole)
        for s, j, _ in [x for x in scored if x[2] == n and x[1] != i][:positives]:
            inside = [x for x in scored if x[2] != n and 30 * -s <= 100 * -x[0] <= 90 * -s][:count]
            out += [(i, j, k, b, -s, -t) for k, (t, b, _) in enumerate(inside, 1)]
    return out


def vector_rows(n=400, dims=9, scale=1.0, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 1]) * scale * rng.random() for _ in range(dims)], None if i % 41 == 5 else rng.randrange(3)) for i in range(n)]
    rows += [(i, rows[0][1], i % 2) for i in range(n, n + 60)]
    rows += [(3000, None, 1), (3100, [0.5, None], 1), (3200, [math.inf], 1), (3300, [math.nan] * dims, 1), (3400, [], 1),
             (3500, [0.25, -0.5], 2), (None, rows[1][1], 1), rows[n // 4], rows[n // 4], rows[n // 2]]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize('scale,tile', [(256, 64), (256, 4096), (1 << 22, 100)])
def test_negatives_equal_plain_version(spark, scale, tile):
    rows = vector_rows()
    got = negatives.hard_negatives(frame_of(spark, rows), F.col('vec_id') % 50 == 0, scale=scale, tile_rows=tile)
    want = plain_negatives(rows, lambda i: i % 50 == 0, scale=scale)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_negatives_of_wide_vectors_and_few_rows(spark):
    rows = vector_rows(60, 200, 3.0)
    got = negatives.hard_negatives(frame_of(spark, rows), F.col('vec_id') < 9, 2, 3)
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows, lambda i: i < 9, 2, 3))
    assert negatives.hard_negatives(frame_of(spark, []), F.lit(True)).count() == 0
    assert negatives.hard_negatives(frame_of(spark, rows), F.lit(None).cast('boolean')).count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(frame_of(spark, [(1, [3e30], 1)]), F.lit(True))


@pytest.mark.parametrize('bits', [3, 12, 24])
def test_residue_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = rng.integers(-2 ** bits, 2 ** bits, (7, 130)), rng.integers(-2 ** bits, 2 ** bits, (11, 130))
    primes = negatives.primes_for(130 << 2 * bits)
    got = negatives.Tile(a, primes).scores(negatives.Tile(b, primes), 0, 7)
    assert (got == a @ b.T).all()
    assert all(negatives.INNER * (p // 2) ** 2 < 1 << 24 for p in primes)


# ---- clustering ----------------------------------------------------------------------------
def plain_clusters(rows, k, rounds, scale, size, seed):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows
             if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda x: ('~' if x[0] is None else hashlib.sha256(f'{seed}:{x[0]}'.encode()).hexdigest(), x[1])
    now = [v for _, v in sorted(whole, key=name)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in whole:
            own[near(v)[1]].append(v)
        now = [[sum(x) // len(x) for x in zip(*own[n])] if n in own else c for n, c in enumerate(now)]
    found = [(i, *near(v)[::-1]) for i, v in whole]
    per = defaultdict(int)
    for _, c, d in found:
        per[c] += d
    sha = [hashlib.sha256(','.join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in found]


@pytest.mark.parametrize('n,size,k', [(300, 9, 8), (300, 2, 5), (3, 9, 8)])
def test_clusters_equal_plain_version(spark, n, size, k):
    rows = [(i, v if v is None else v[:size], c) for i, v, c in vector_rows(max(n, 201), size)][:n]
    rows += [(None, rows[0][1], 0), (5, rows[1][1], 0), (6, [None] * size, 0), (8, [math.nan] * size, 0), (9, [0.1], 0), (10, None, None)]
    got = centroids.clustered(frame_of(spark, rows), k, 4, 100, size, 'x')
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_clusters(rows, k, 4, 100, size, 'x')))


def test_clusters_of_nothing_and_of_too_large_vectors(spark):
    assert centroids.clustered(frame_of(spark, []), size=2).collect() == []
    with pytest.raises(ValueError):
        centroids.clustered(frame_of(spark, [(1, [1e30, 0.0], 1)]), size=2)


@pytest.mark.parametrize('seed', range(4))
def test_the_walk_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    span = [3, 50, 10 ** 6, 2][seed]
    x, c = rng.integers(-span, span + 1, (500, 5)), rng.integers(-span, span + 1, (12, 5))
    number, distance = centroids.Centroids(c.tolist()).nearest(x)
    full = ((x[:, None] - c) ** 2).sum(2)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_queries_equal_sql(spark, sf):
    for table in ('documents', 'embeddings'):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    for run, sql in ((linededup.op11_line_dedup, linededup.SQL), (negatives.op12_hard_negatives, negatives.SQL),
                     (centroids.op13_centroid_clustering, centroids.oracle())):
        got = run(spark, sf)
        assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f'SELECT {", ".join(got.columns)} FROM ({sql})').fetchall())
