"""Words, fingerprints, near duplicates and licences against plain Python."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefindings.llm import components, fingerprints, license_texts, licenses, neardup, words
from tests.llm import cases


def test_word_hashes_equal_split_words():
    texts = ['Hello  World\n foo', '', 'a', ' \t ', 'x y z w v u', 'é ü\xa0b C', 'w' * 300_000 + ' tail', None, 'HELLO', 'v' * 3_000_000]
    hashes, bounds = words.word_hashes(*words.buffer_of(pa.array(texts)))
    seen = {}
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        split = (text or '').encode().lower().split()
        assert b - a == len(split)
        assert all(seen.setdefault(w, h) == h for w, h in zip(split, hashes[a:b]))
    assert len(set(seen.values())) == len(seen)
    again, _ = words.word_hashes(*words.buffer_of(pa.array(texts[2:])))
    assert (again == hashes[bounds[2]:]).all()


def test_long_texts_are_hashed_in_pieces_alike():
    text = cases.prose(400_000, 4)
    whole, _ = words.word_hashes(*words.buffer_of(pa.array([text])))
    middle = text.split(' ')[200_000:200_050]
    some, _ = words.word_hashes(*words.buffer_of(pa.array([' '.join(middle)])))
    assert (whole[200_000:200_050] == some).all()


def shingles(text, width):
    w = (text or '').encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketch_estimates():
    a, b = cases.prose(3000, 1), cases.prose(3000, 2)
    texts = [a, a + ' ' + b, b, cases.changed(a, 40), '', 'few words']
    made = fingerprints.sketches(pa.array(texts))
    sets = [shingles(t, 5) for t in texts]
    for x, s in zip(made, sets):
        assert abs(fingerprints.distinct_count(x) - len(s)) <= 0.35 * len(s)
        assert (fingerprints.decoded(fingerprints.encoded(x)) == x).all()
    for i in range(6):
        for j in range(6):
            assert abs(fingerprints.resemblance(made[i], made[j]) - jaccard(sets[i], sets[j])) < 0.15
    assert abs(fingerprints.containment(made[0], made[1]) - 1) < 0.25
    halves = fingerprints.sketches(pa.array([a, b]))
    assert abs(fingerprints.resemblance(fingerprints.merged(*halves), made[1]) - 1) < 0.1


def test_fingerprints_of_all_rows(spark):
    docs = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ''))
    want = []
    for k, row in enumerate(docs):
        text, following = row[1] or '', docs[(k + 1) % len(docs)][1] or ''
        edited = fingerprints.edited_text(text, following)
        a, e, n = fingerprints.sketches(pa.array([text, edited, following]))
        want.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.encoded(a), fingerprints.encoded(e),
                     fingerprints.resemblance(a, e), fingerprints.resemblance(a, n)))
    key = lambda r: tuple(str(x) for x in r)
    for size in (1 << 30, 2000):
        got = [tuple(r)[:7] for r in fingerprints.fingerprint(cases.frame(spark), size).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert fingerprints.fingerprint(cases.empty(spark)).count() == 0
    alone = fingerprints.fingerprint(cases.frame(spark, cases.rows()[:1])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def components_of(texts, how):
    """Component number of every text by comparing all pairs; None for empty sets."""
    sets = [shingles(t, how.width) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    index = defaultdict(list)
    for i, s in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for j in index[x]:
                near[j] += 1
            index[x].append(i)
        for j, both in near.items():
            if 100 * both >= how.percent * (len(s) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) if s else None for i, s in enumerate(sets)], sets


@pytest.mark.parametrize('how', [neardup.CONTRACT, neardup.Likeness()])
def test_near_duplicates_equal_all_pairs(spark, sf, how):
    docs = spark.read.parquet(f'{sf}/documents.parquet').select('doc_id', 'text').collect()
    base = cases.prose(300, 7)
    texts = [(r.doc_id, r.text) for r in docs]
    texts += [(10_000 + i, cases.changed(base, every, i)) for i, every in enumerate([300, 200, 150, 100, 70, 50, 40, 30, 20, 12, 9, 7, 5] * 12)]
    groups, sets = components_of([t for _, t in texts], how)
    least = defaultdict(lambda: math.inf)
    for (doc_id, _), g in zip(texts, groups):
        if g is not None:
            least[g] = min(least[g], doc_id)
    want = {d: (len(s), d if g is None else least[g]) for (d, _), g, s in zip(texts, groups, sets)}
    frame = spark.createDataFrame(texts, 'doc_id long, text string').repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, how).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    how = neardup.CONTRACT
    rows = cases.rows()
    groups, sets = components_of([r[1] for r in rows], how)
    got = neardup.near_duplicates(cases.frame(spark), how).collect()
    assert len(got) == len(rows)
    assert sum(r.n_shingles == 0 for r in got) == sum(not s for s in sets)
    for doc_id, group in [(0, 0), (1, 0), (16, 0), (5, 4)]:
        assert {r.component_id for r in got if r.doc_id == doc_id} == {group}
    kept = neardup.one_of_each(cases.frame(spark), how).collect()
    assert kept[0].__fields__ == [f.split()[0] for f in cases.SCHEMA.split(', ')]
    again, kept_sets = components_of([r.text for r in kept], how)
    assert len({g for g in again if g is not None}) == len([g for g in again if g is not None]) == len({g for g in groups if g is not None})
    assert sum(not s for s in kept_sets) == sum(not s for s in sets)
    assert neardup.near_duplicates(cases.empty(spark), how).count() == 0 and neardup.one_of_each(cases.empty(spark), how).count() == 0


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, 'BLOCK_ROWS', 16)
    monkeypatch.setattr(neardup, 'BROADCAST_ROWS', 0)
    base = cases.prose(200, 8)
    texts = [(i, cases.changed(base, [100, 60, 40, 25][i % 4], i)) for i in range(150)]
    groups, _ = components_of([t for _, t in texts], neardup.CONTRACT)
    frame = spark.createDataFrame(texts, 'doc_id long, text string').repartition(4)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, neardup.CONTRACT).collect()} == dict(enumerate(groups))


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, 'a long, b long')).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 400: 400, 450: 400, 500: 400}


def test_license_scan(spark):
    mit = licenses.TEXTS['MIT']
    texts = [mit, 'The MIT thing\n' + mit, '/* Copyright (c) 2020 Some One. */\n' + mit.upper().replace(',', ' ;'),
             mit.replace('license', 'licence').replace('\n\n', '\n * \n'), 'Prose.\n  Licensed under the Apache Licence, version 2.0.\nMore.',
             None, '', 'Copyright 2020 X', mit]
    frame = spark.createDataFrame([(None if i == 8 else i, t, 'x') for i, t in enumerate(texts)], 'doc_id long, text string, license string')
    known = licenses.known_digests(spark)
    got = [(r.doc_id, r.license, r.notices) for r in licenses.scan(frame, known).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == [
        (0, 'MIT', ''), (1, None, ''), (2, 'MIT', ''), (3, 'MIT', ''), (4, None, 'Apache-2.0'), (5, None, ''), (6, None, ''),
        (7, None, ''), (None, 'MIT', '')]
    assert licenses.scan(cases.empty(spark), known).count() == 0
    own = licenses.known_digests(spark, [('Own', 'Do what you like!')])
    assert [r.license for r in licenses.scan(frame.limit(1).withColumn('text', F.lit('do what YOU like')), own).collect()] == ['Own']


def test_license_files_with_and_without_heading(spark):
    mit, bsd = licenses.TEXTS['MIT'], licenses.TEXTS['BSD-2-Clause']
    long = {f.stem: f.read_text() for f in license_texts.FILES.glob('*.txt')}
    apache = long['Apache-2.0']
    texts = [('MIT', 'MIT License\n\nCopyright (c) 2020 Some One\n\n' + mit), ('BSD-2-Clause', 'BSD 2-Clause License\n\n' + bsd),
             ('Apache-2.0', apache[:apache.index('   APPENDIX')]),
             ('Apache-2.0', apache.replace('Copyright [yyyy] [name of copyright owner]', 'Copyright 2021 Some One')),
             ('BSD-3-Clause', 'Copyright 2020 X\nAll rights reserved.\n\n' + re.sub(r'(?m)^[123]\.', '*', long['BSD-3-Clause'])),
             ('GPL-3.0', long['GPL-3.0'].split('\n', 2)[2].replace('https://', 'http://')), ('GPL-2.0', '// ' + long['GPL-2.0'].replace('\n', '\n// ')),
             *((name.split('~')[0], text) for name, text in sorted(long.items())), (None, apache.replace('royalty', 'loyalty'))]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], 'doc_id long, text string')
    got = {r.doc_id: r.license for r in licenses.scan(frame, licenses.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == [want for want, _ in texts]
    assert {'Apache-2.0', 'GPL-2.0', 'GPL-3.0', 'LGPL-3.0', 'MPL-2.0', 'BSD-3-Clause', 'Unlicense', 'CC0-1.0', 'CC-BY-SA-4.0'} <= set(got.values())


@pytest.mark.parametrize('broadcast', [200_000, 0])
def test_one_group_of_half_the_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(neardup, 'BROADCAST_ROWS', broadcast)
    text = cases.prose(150, 1)
    rows = [(i, cases.changed(text, 75, i) if i % 2 else text) for i in range(600)] + [(1000 + i, cases.prose(60, i)) for i in range(600)]
    frame = spark.createDataFrame(rows, 'doc_id long, text string').repartition(7)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, neardup.Likeness()).collect()}
    assert got == {i: 0 if i < 600 else i for i, _ in rows}
    assert sorted(r.doc_id for r in neardup.one_of_each(frame, neardup.Likeness()).collect()) == [0, *range(1000, 1600)]


def test_components_of_hubs_and_chains(spark):
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(9000, 8000), (8000, 9000), (7, 7)]
    found = components.components(spark.createDataFrame(links, 'a long, b long').repartition(5)).collect()
    want = {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5041)} | {8000: 8000, 9000: 8000}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    assert components.components(spark.createDataFrame([], 'a long, b long')).count() == 0
