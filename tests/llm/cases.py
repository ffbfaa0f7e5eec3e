"""Small tables with everything that may be odd about documents."""

import random

SCHEMA = 'doc_id long, text string, lang string, source string, n_chars long, size long, _row string, hash long, score double'
WORDS = 'alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau'.split()


def prose(n, seed):
    rng = random.Random(seed)
    return ' '.join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def changed(text, every, seed=0):
    words = text.split(' ')
    for i in range(seed % every, len(words), every):
        words[i] = f'new{seed}x{i}'
    return ' '.join(words)


def rows():
    a, b = prose(120, 1), prose(200, 2)
    texts = [a, a, changed(a, 60, 1), changed(a, 8, 2), b, b.upper(), b + ' more words here', '', None, '  \n\t ', 'one', 'one two',
             'One two', prose(4000, 3), 'x' * 20000, 'same line\n' * 30, a, 'mail me: some.body@mail3.example.com or +1 (017) 555-7713',
             'server 10.20.30.40 card 4111 1111 1111 1111', '1 2 3']
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(None, a), (None, prose(90, 9)), (None, None), (4, b), (4, b), (2, prose(70, 5))]
    sources = ['s1', 's2', None, 's1', '', 's1']
    return [(i, t, [None, 'en', 'de'][k % 3], sources[k % 6], None if t is None else len(t), 7, 'r', 1, 0.5)
            for k, (i, t) in enumerate(out)]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, ids=range(20)):
    return spark.createDataFrame([(i, i % 4 != 3, 0) for i in ids], 'doc_id long, quality boolean, toxic int').selectExpr(
        'doc_id', 'CAST(quality AS int) AS quality', 'toxic')
