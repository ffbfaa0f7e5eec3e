"""Language model, mixing, sharding, packing, rules, classifier, personal data and the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codefindings.llm import boosting, katz, mixing, packing, pii, quality, registry, rules, sharding
from tests.llm import cases


def crc(doc_id):
    return zlib.crc32(b'' if doc_id is None else str(doc_id).encode())


# ---- language model ------------------------------------------------------------------------
def plain_katz(docs):
    tokens = [[('w', w) for w in (t or '').encode().lower().split()] + ['end'] for _, t in docs]
    train = [k for k, (i, _) in enumerate(docs) if crc(i) % 7 != 2]
    single, pairs = Counter(), Counter()
    for k in train:
        single.update(tokens[k])
        pairs.update(zip(['start'] + tokens[k][:-1], tokens[k]))
    total, distinct = sum(single.values()), len(single)
    cut = katz.discounts(Counter(pairs.values()))
    d = lambda n: cut[n - 1] if n <= katz.TOP else n
    p = lambda w: (single[w] + 1) / (total + distinct + 1)
    seen = defaultdict(list)
    for (v, w), n in pairs.items():
        seen[v].append((w, n))
    count = {v: sum(n for _, n in x) for v, x in seen.items()}
    weight = {v: (1 - sum(d(n) for _, n in x) / (count[v] + 1)) / (1 - sum(p(w) for w, _ in x)) for v, x in seen.items()}
    for v, x in seen.items():
        assert abs(sum(d(n) for _, n in x) / (count[v] + 1) + weight[v] * (1 - sum(p(w) for w, _ in x)) - 1) < 1e-9
    out = []
    for (i, _), t in zip(docs, tokens):
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10(d(pairs[v, w]) / (count[v] + 1) if pairs[v, w] else weight.get(v, 1) * p(w))
                    for v, w in zip(['start'] + t[:-1], t))
        out.append((i, crc(i) % 7 == 2, len(t), sum(single[w] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return out


def katz_rows(frame, bucket):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
            for r in katz.score(frame, bucket).collect()]


@pytest.mark.parametrize('bucket', [2_000_000, 4_000])
def test_katz_equals_plain_model(spark, sf, bucket):
    docs = [tuple(r) for r in spark.read.parquet(f'{sf}/documents.parquet').select('doc_id', 'text').collect()]
    docs += [(1000 + i, 'the of ' * 400) for i in range(40)]
    frame = spark.createDataFrame(docs, 'doc_id long, text string').repartition(3)
    assert sorted(katz_rows(frame, bucket)) == sorted(plain_katz(docs))


def test_katz_on_odd_rows(spark):
    want = plain_katz([(r[0], r[1]) for r in cases.rows()])
    assert sorted(map(str, katz_rows(cases.frame(spark), 1000))) == sorted(map(str, want))
    assert katz.score(cases.empty(spark)).count() == 0
    unlearnt = next(i for i in range(99) if crc(i) % 7 == 2)
    only = katz.score(spark.createDataFrame([(unlearnt, 'a b')], 'doc_id long, text string')).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in only] == [(3, 0, 0, 0.0)]


# ---- mixing --------------------------------------------------------------------------------
def test_targets_and_copies(spark):
    rows = cases.rows()
    size = lambda t: len(re.findall(r'[^\x20\x09-\x0D]+', t or ''))
    per = Counter()
    for r in rows:
        per[r[3]] += size(r[1])
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    budget = 1.5 * sum(per.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * per[s]}
        if not full:
            break
        target |= {s: 2.0 * per[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    got = mixing.copies(cases.frame(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.copies <= 2 and abs(r.copies - r.target / max(1, r.source_size)) < 1
    assert Counter(map(str, got)) == Counter(map(str, mixing.copies(cases.frame(spark)).collect()))
    mixed = mixing.mix(cases.frame(spark))
    assert mixed.columns == cases.frame(spark).columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.copies(cases.empty(spark)).count() == 0 and mixing.mix(cases.empty(spark)).count() == 0
    blank = mixing.copies(cases.frame(spark, [r for r in rows if not (r[1] or '').strip()])).collect()
    assert all(r.target == 0 and r.copies == 0 for r in blank)


def test_mix_meets_targets_with_a_hot_source(spark):
    rows = [(i, 'w ' * (20 + i % 30), f's{0 if i % 3 else i % 7}') for i in range(6000)]
    got = mixing.copies(spark.createDataFrame(rows, 'doc_id long, text string, source string')).groupBy('source', 'target').agg(
        F.sum(F.col('size') * F.col('copies')).alias('taken')).collect()
    assert all(abs(r.taken / r.target - 1) < 0.15 for r in got)


# ---- sharding ------------------------------------------------------------------------------
def test_shards_fit_and_cover(spark, tmp_path):
    rows = [(i, 'x' * (i % 97), 'en') for i in range(1500)] + [(9999, 'y' * 4000, 'en')] + [(7, 'z' * 300, None)] * 40 + [
        (None, None, 'a'), (None, 'q', 'a'), (3, '', 'b')]
    frame = spark.createDataFrame(rows, 'doc_id long, text string, shard_bytes string').repartition(4)
    got = sharding.assign(frame, limit=2000).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for name, own in shards.items():
        total = sum(r.n_bytes for r in own)
        assert {(r.shard_bytes, r.shard_docs) for r in own} == {(total, len(own))}
        assert total <= 2000 or len(own) == 1
    bits = sorted(s.split('-')[0] for s in shards)
    assert not any(b.startswith(a) and a != b for a, b in zip(bits, bits[1:]))
    assert any('-' in s for s in shards)
    assert sharding.assign(cases.empty(spark)).count() == 0
    sharding.write_shards(frame.drop('shard_bytes'), str(tmp_path / 'out'), 2000)
    assert spark.read.parquet(str(tmp_path / 'out')).count() == len(rows)


# ---- packing -------------------------------------------------------------------------------
def test_plan_equals_best_fit_of_single_pieces():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([7, 20, 64, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 15))}
        pieces = [n for n in sorted(counts, reverse=True) for _ in range(counts[n])]
        rooms = []
        for n in pieces:
            fits = [r for r in rooms if r >= n]
            room = min(fits, default=capacity)
            if fits:
                rooms.remove(room)
            rooms.append(room - n)
        runs = packing.plan(counts, capacity)
        first, bins = [r[0] for r in runs], defaultdict(list)
        for k, n in enumerate(pieces):
            r = runs[np.searchsorted(first, k, 'right') - 1]
            assert r[1] == n
            bins[r[2] + (k - r[0]) // r[3]].append((r[4] + (k - r[0]) % r[3] * n, n))
        for own in bins.values():
            own.sort()
            assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        assert sorted(capacity - sum(n for _, n in own) for own in bins.values()) == sorted(rooms)


def test_word_ids_equal_the_tokenizer():
    words = packing.WordTokens(packing.tokenizer_path())
    rng, texts = random.Random(2), ['', '  ']
    for _ in range(3000):
        text = ''.join(rng.choice("abZé.,!'s<|>endoftxÑß1٣́İΣſKÅẞ-\"漢字 \n ") for _ in range(rng.randint(0, 14)))
        text += rng.choice(["don't", '<|endoftext|>', 'a<|endoftext|>b', 'ABC...', ' ', 'é!!'])
        if '<|' not in text:
            texts.append(text)
    for some in (texts[:5], texts, texts[::-1]):
        ids, bounds = words.encode(pa.array(some))
        for k, text in enumerate(some):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [0], text


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, 'CACHED', 50)
    tokenizer = packing.WordTokens(packing.tokenizer_path()).tokenizer
    want = Counter()
    rows = cases.rows() + [(77, 'a <|endoftext|> b<|startoftext|>', None, None, 0, 0, '', 0, 0.0)]
    for r in rows:
        ids = tokenizer.encode(r[1] or '', add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            own = ids[at:at + 256]
            want[r[0], piece, at, len(own), zlib.crc32(np.array(own, '<u4').tobytes())] += 1
    got = packing.pack(cases.frame(spark, rows), packing.tokenizer_path(), 256).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 256
    assert len(bins) <= sum(n for r, n in [(k, v * k[3]) for k, v in want.items()]) / 256 * 1.1 + 1
    assert packing.pack(cases.empty(spark), packing.tokenizer_path()).count() == 0


# ---- quality rules -------------------------------------------------------------------------
def plain_counts(text):
    words = re.findall(r'[^\x20\x09-\x0D]+', text or '')
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or '').split('\n') if re.search(r'[^\x20\x09-\x0D]', x)]
    return (len(words), sum(map(len, words)), sum(c in '#*$%&|<>' for c in text or ''), len(lines) - len(set(lines)), len(covered))


def test_rule_counts(spark):
    odd = ['a a a a', 'a b c a b c', 'x y z\nx y z\n\nx y z', 'é ' * 60 + '#$ |', 'p q\r\np q\r\n', 'a b c d a b c']
    rows = cases.rows() + [(100 + i, t, None, None, 0, 0, '', 0, 0.0) for i, t in enumerate(odd)]
    got = rules.judge(cases.frame(spark, rows), cases.labels(spark)).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = Counter()
    for r in rows:
        n = plain_counts(r[1])
        want[(r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert have == want and all(r.kept == (not r.base_failed) for r in got)
    assert rules.judge(cases.empty(spark), cases.labels(spark)).count() == 0


def test_binomial_bound(spark):
    rows = [(k, n) for n in (1, 7, 90, 4000) for k in (0, 1, 3, n // 20, n) if k <= n]
    frame = spark.createDataFrame(rows, 'k long, n long')
    for r in frame.select('k', 'n', rules.binomial_below(F.col('k'), F.col('n'), 0.05).alias('p')).collect():
        log = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(.05) + (r.n - i) * math.log(.95)
               for i in range(r.k + 1)]
        assert abs(r.p - sum(map(math.exp, log))) < 1e-9


def test_cutoffs_equal_plain_search(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        stratum = ['en', 'de', None, 'rare'][0 if i % 10 < 6 else 1 if i % 10 < 8 else 2 if i % 100 != 99 else 3]
        rows.append((i, stratum, [min(1000, int(rng.expovariate(1 / 30))) for _ in rules.NAMES]))
    frame = spark.createDataFrame(rows, 'doc_id long, stratum string, marks array<int>')
    got = {r.stratum: (r.step, list(r.cuts)) for r in rules.cutoffs(frame).collect()}
    strata = {s for i, s, _ in rows if crc(i) % 2 == 1}
    want = {}
    for s in strata:
        tune = [m for i, t, m in rows if t == s and crc(i) % 2 == 0]
        hold = [m for i, t, m in rows if t == s and crc(i) % 2 == 1]
        for step, q in enumerate(rules.STEPS):
            cuts = []
            for j in range(len(rules.NAMES)):
                values = sorted(m[j] for m in tune)
                cuts.append(next(v for v in sorted(set(values)) if sum(x <= v for x in values) >= q * len(values)))
            k, n = sum(any(m[j] > cuts[j] for j in range(len(cuts))) for m in hold), len(hold)
            p = sum(math.comb(n, i) * .05 ** i * .95 ** (n - i) for i in range(k + 1))
            if p > rules.DELTA / len(strata):
                break
            want[s] = (step, cuts)
    assert got == want and 'rare' not in got and len(got) >= 2


# ---- classifier ----------------------------------------------------------------------------
def test_discriminant_density():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 2, (60, 3)), 1: rng.normal(1, 1, (400, 3))}
    model = quality.discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()})
    z = rng.normal(0, 2, (20, 3))
    gaps = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        delta = z - model.means[k]
        gaps.append(-0.5 * np.einsum('ij,jk,ik->i', delta, np.linalg.inv(cov), delta) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(z), 1 / (1 + np.exp(-(gaps[1] - gaps[0]) / 3)))
    assert quality.discriminant({1: (5, np.zeros(3), np.eye(3))}) is None


def test_classifier_on_held_out_rows(spark):
    sf = '/root/testdata/sf0.01'
    docs, marks = (spark.read.parquet(f'{sf}/{t}.parquet') for t in ('documents', 'labels'))
    rows = quality.scored(docs, marks).join(marks, 'doc_id').filter('held_out').collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    swapped = marks.withColumn('quality', F.when(F.crc32(F.col('doc_id').cast('string')) % 5 == 0, 1 - F.col('quality')).otherwise(F.col('quality')))
    assert {r.doc_id: round(r.score, 9) for r in quality.scored(docs, swapped).collect()} == {
        r.doc_id: round(r.score, 9) for r in quality.scored(docs, marks).collect()}


def test_classifier_on_odd_rows(spark):
    got = quality.scored(cases.frame(spark), cases.labels(spark)).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    none = cases.labels(spark, [])
    assert {r.score for r in quality.scored(cases.frame(spark), none).collect()} == {1.0}
    kept = quality.accepted(cases.frame(spark), none)
    assert kept.columns == cases.frame(spark).columns and kept.count() == len(cases.rows())
    assert quality.scored(cases.empty(spark), none).count() == 0


# ---- personal data -------------------------------------------------------------------------
PLAIN = [('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
         ('card', r'[0-9]([\x20-]?[0-9])+'), ('phone', r'\+[0-9][\x20().0-9-]+[0-9]')]


def plain_spans(text):
    def passes(kind, own):
        digits = re.sub(r'\D', '', own)
        return (kind == 'email' or kind == 'ip' and all(int(x) <= 255 for x in own.split('.'))
                or kind == 'card' and 13 <= len(digits) <= 19 and pii.luhn(digits) or kind == 'phone' and 9 <= len(digits) <= 15)
    return [(k, m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, text) if passes(k, m[0])]


def test_base_spans_equal_patterns():
    rng = random.Random(1)
    for alphabet in ('a@.12-+ ()0', '0123456789. -+', 'ab@@..-'):
        for _ in range(6000):
            text = ''.join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_spans_of_a_corpus(spark):
    docs = spark.read.parquet('/root/testdata/sf0.01/documents.parquet').unionByName(
        cases.frame(spark).select('doc_id', 'text', 'lang', 'source', 'n_chars'))
    detector = pii.learn(docs)
    texts = [r.text or '' for r in docs.select('text').collect()]
    want = Counter(hashlib.sha256(pii.named(plain_spans(t)).encode()).hexdigest() for t in texts)
    got = pii.find(docs, detector).collect()
    assert Counter(r.base_sha256 for r in got) == want
    found = 'Call (555) 123-4567 now or write to bob [at] example.com'
    assert {k for k, _, _ in detector.more([found], [plain_spans(found)])[0]} == {'phone', 'email'}
    assert detector.more(['card 4111 1111 1111 1112, version 12.4.300.5, order 20240102'], [[]]) == [[]]
    clean = pii.redact(docs, detector)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    left = [t for t in (r.text or '' for r in clean.collect()) if any(k != 'card' for k, _, _ in plain_spans(t))]
    assert not left and clean.filter('n_chars <> length(text)').count() == 0
    assert pii.find(cases.empty(spark)).count() == 0 and pii.redact(cases.empty(spark)).collect() == []


def test_rare_kinds_get_trees_and_thresholds(spark):
    rng = random.Random(3)
    plain = [(i, f'item {rng.randrange(10**4)} of {cases.prose(12, i)}') for i in range(8000)]
    rare = [(10_000 + i, f'{cases.prose(5, i)} call +1 (555) {rng.randrange(100, 1000)}-{rng.randrange(1000, 10**4)} now {i}') for i in range(8)]
    docs = spark.createDataFrame(plain + rare, 'doc_id long, text string').repartition(5)
    detector = pii.learn(docs)
    found = 'Call (555) 123-4567 now'
    assert {k for k, _, _ in detector.more([found], [[]])[0]} == {'phone'}
    assert pii.learn(docs.repartition(2)).thresholds == detector.thresholds


def test_thresholds_cover_all_examples_kept_back(spark):
    docs = spark.read.parquet('/root/testdata/sf0.001/documents.parquet').select('doc_id', 'text')
    texts = docs.select(pii.leading_bits(pii.whole_text(), 15), pii.whole_text()).collect()
    sums = np.zeros((len(pii.KINDS), 3), int)
    for order, text in texts:
        for _, span, label in pii.examples(text, str(order), unlabelled=True):
            sums[pii.KINDS.index(span[0]), label] += 1
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts])], names=['_order', 'text'])
    got = np.zeros_like(sums)
    for k, _, label, n in zip(*(c.to_pylist() for c in next(pii._binned(iter([batch]), boosting.Boosted(0.0, []), frozenset())).columns)):
        got[k, label] += n
    assert sums.sum() and (got == sums).all()
    for part in pii._drawn(iter([batch, batch]), 3):
        assert len(set(part.column('_hash').to_pylist())) == len(part) <= 3


def test_kind_without_positive_examples_is_not_switched_off():
    sums = np.zeros((len(pii.KINDS), len(pii.BINS), 2))
    sums[0, -1, 1] = sums[0, 5, 0] = 100
    cuts = pii.thresholds_of(sums, 0.98)
    assert cuts['ssn'] == cuts['email'] <= 1
    sums[5, -1] = 50, 50
    assert pii.thresholds_of(sums, 0.98)['ssn'] == 2.0


def test_unlabelled_proposals_teach_nothing():
    text = 'so john [at] mail.com and 555-123-4567 and 123-45-6789 and 2001:db8::1 and ' + 'a1' * 12
    assert list(pii.examples(text, '1')) == []
    assert [label for *_, label in pii.examples(text, '1', unlabelled=True)] == [2] * 5
    refused = 'x20240131y 4111111111111112 20240131 order no. 555-123-4567 000-12-3456 Add::Bad noon at end.Then 1.2.3.999'
    assert {label for *_, label in pii.examples(refused, '1', unlabelled=True)} == {0}


def test_thresholds_count_negatives_among_the_unlabelled():
    sums = np.zeros((len(pii.KINDS), len(pii.BINS), 3))
    high, top = int(np.searchsorted(pii.BINS, 0.9)), len(pii.BINS) - 1
    sums[0, top, 1], sums[0, 5, 0], sums[0, high, 0] = 1000, 980, 15
    assert pii.thresholds_of(sums, 0.98)['email'] == pii.BINS[int(np.searchsorted(pii.BINS, 0.5))]
    sums[0, 5, 2], sums[0, high, 2] = 980, 15
    assert pii.thresholds_of(sums, 0.98)['email'] > pii.BINS[high]
    sums[0, top, 2] = 5000
    assert pii.thresholds_of(sums, 0.98)['email'] <= pii.BINS[high]


@pytest.mark.parametrize('share', [0.02, 0.25, 0.5])
def test_other_spellings_are_found_at_any_share(spark, share):
    rng = random.Random(int(share * 100))
    names = ['john.doe', 'anna', 'mary_k', 'bob77', 'x.y-z', 'li']
    rows, want, clean = [], {}, set()
    for i in range(1500):
        kind = ['email', 'phone', 'ssn'][i % 3]
        other = rng.random() < share
        user, host = rng.choice(names) + str(rng.randrange(99)), f'{rng.choice(["mail", "web", "corp"])}{rng.randrange(9)}.example.com'
        a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        if kind == 'ssn' and not other:
            own = f'{user}@{host}'
        elif kind == 'ssn':
            own = f'{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{c}'
        elif kind == 'email':
            own = f'{user} [at] {host}' if other else f'{user}@{host}'
        else:
            own = f'({a}) {b}-{c}' if other else f'+1 {a} {b} {c}'
        text = f'{cases.prose(15, i)} write to {own} soon {cases.prose(5, -i)}'
        if other:
            want[i] = (kind, text.index(own), text.index(own) + len(own))
        rows.append((i, text))
    for i in range(1500, 3000):
        clean.add(i)
        rows.append((i, f'{cases.prose(10, i)} we met at noon.Then order no. {rng.randrange(10**8)} of 20240{rng.randrange(1, 10)}11 and '
                        f'{rng.randrange(10**15, 10**16)} or 1.2.3.{rng.randrange(256, 999)} {cases.prose(5, -i)}'))
    docs = spark.createDataFrame(rows, 'doc_id long, text string').repartition(6)
    spans = {r.doc_id: set(filter(None, r.spans.split(','))) for r in pii.find(docs).collect()}
    found = [i for i, s in want.items() if pii.named([s]) in spans[i]]
    base = {i: set(filter(None, pii.named(pii.base_spans(t)).split(','))) for i, t in rows}
    wrong = [x for i in spans for x in spans[i] - base[i] if i in clean or (i not in want) or x != pii.named([want[i]])]
    assert len(found) >= 0.9 * len(want)
    assert len(wrong) <= 0.02 * max(50, len(found)), wrong[:20]


def test_long_spelled_addresses_are_proposed_whole():
    for user, host in (('u' * 300, 'mail.com'), ('a', 'h' * 200 + '.' + '.'.join('d' * 70 for _ in range(9)) + '.org')):
        for mark in (' [at] ', '(at)', ' at ', '{AT}'):
            own = user + mark + host
            assert ('email', 4, 4 + len(own)) in pii.proposals(f'so, {own}, is it'), own


@pytest.mark.parametrize('kind, own', [
    ('email', 'john [At] mail.com'), ('email', 'john at host.com'), ('email', 'JOHN AT HOST DOT COM'), ('email', 'john At mail Dot com'),
    ('ip', '2001:db8::1'), ('ip', 'fe80::1'), ('ip', '::1'), ('ip', '2001:db8::'), ('ip', '2001:0db8:0:0:0:0:0:1'),
    ('phone', '(555)123-4567'), ('phone', '(555) 123-4567'), ('phone', '555-123-4567')])
def test_spellings_are_proposed(kind, own):
    for text in (own, f'so, {own} is it', f'({own}).'):
        at = text.index(own)
        assert (kind, at, at + len(own)) in pii.proposals(text), text


def test_no_address_is_proposed_between_names():
    for text in ('std::vector', 'a :: b', 'x::y', '::', '1:2:3:4:5:6:7::8', '12:30::pm'):
        assert not [p for p in pii.proposals(text) if p[0] == 'ip'], text


def test_overlap_by_bisect():
    rng = random.Random(2)
    for _ in range(300):
        spans = [('ip', s, s + rng.randint(1, 12)) for s in rng.choices(range(60), k=rng.randint(0, 8))]
        cover, taken, plain = pii.Cover(spans), [], []
        for s in rng.choices(range(70), k=20):
            span = 'phone', s, s + rng.randint(1, 9)
            touched = lambda others: any(s < e and b < span[2] for _, b, e in others)
            assert cover.touches(span) == touched(spans)
            assert pii.placed(taken, span) == (not touched(plain))
            plain += [] if touched(plain) else [span]


def test_log_of_addresses_takes_linear_time_and_a_bounded_sample():
    text = '\n'.join(f'10.{i >> 8 & 255}.{i & 255}.7 from 5551234' for i in range(40_000))
    begun = time.monotonic()
    assert sum(1 for _ in pii.examples(text, '1')) > 200_000
    assert time.monotonic() - begun < 60
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=['_order', 'text'])
    parts = list(pii._drawn(iter([batch]), 50))
    assert parts and all(len(p) <= 50 and len({*zip(p['kind'].to_pylist(), p['label'].to_pylist())}) == 1 for p in parts)


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (2000, 4)).astype(float)
    y = ((x[:, 0] > 4) & (x[:, 2] < 3)).astype(float)
    model = boosting.boost(x, y)
    assert ((model.predict(x) > 0.5) == (y == 1)).mean() > 0.99
    assert boosting.boost(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]


# ---- all queries ---------------------------------------------------------------------------
def test_queries_equal_sql(spark, sf):
    from tests.oracle import compare, connect
    registry.load()
    for name, sql in registry.ORACLES.items():
        assert compare(spark, connect(sf), name, registry.QUERIES[name], sql, sf) is None, name


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f'{sf}/documents.parquet')
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ['quality', 'near duplicates', 'personal data', 'mixing', 'packing']
    before = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f'{sf}/labels.parquet').collect()}
    scores = {r.doc_id: r.predicted for r in registry.QUERIES['op3_quality_discriminant'](spark, sf).collect()}
    good = steps['quality'](spark, docs, sf)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i in before if scores[i]}
    assert sum(marks[i] == 1 for i in marks if not scores[i]) <= 2
    single = steps['near duplicates'](spark, good, sf)
    from tests.llm.test_text_operators import components_of
    from codefindings.llm.neardup import Likeness
    ids = sorted(r.doc_id for r in good.collect())
    groups, _ = components_of([before[i] for i in ids], Likeness())
    assert {r.doc_id for r in single.collect()} == {i for k, i in enumerate(ids) if groups[k] in (None, k)}
    clean = steps['personal data'](spark, single, sf)
    assert clean.columns == docs.columns and clean.count() == single.count()
    mixed = steps['mixing'](spark, clean, sf)
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = steps['packing'](spark, mixed, sf)
    assert packed.filter('piece = 0').count() == mixed.count()
    assert corpus_pipeline.run(spark, sf).filter('piece = 0').count() == mixed.count()
