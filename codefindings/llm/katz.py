"""Language-model scores: a bigram model with Katz backoff.

Tokens are words and one end per text; the first token's context is a start mark. The model is

    P(w | v) = D(c(v, w)) / (c(v) + 1)        if the pair was seen in training
             = a(v) * P(w)                    else
    P(w)     = (c(w) + 1) / (N + V + 1)       unseen words share one more class

``D`` is the Good-Turing discounted count for counts up to ``TOP`` and the count itself above;
``a(v)`` is what the seen pairs leave over, divided by what their words leave over in ``P(w)``, so
that every context sums to exactly 1. The one added to ``c(v)`` keeps that rest above zero where all
counts of a context are large.

One shuffle does the counting and the scoring. Tasks cut their tokens into postings (word, context,
document) and send them to buckets by word; a bucket sees all pairs that end in its words, so it has
``c(v, w)`` and ``c(w)`` without a lookup. It writes its part of the tables (pairs, contexts, counts
of counts) and, per document, sums in which only the discounts and the total counts are open.
Contexts are summed over buckets, which gives the backoff weights; unseen pairs look up theirs.
Words that would overfill a bucket are spread over all buckets by (word, context); how often they
occur is counted before. There are at most two such words per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codefindings.llm.common import doc_id, documents, stored, whole_text
from codefindings.llm.registry import query
from codefindings.llm.words import buffer_of, distinct, mixed, slices, word_hashes

START, END = np.uint64(0x5350414E5F535441), np.uint64(0x5350414E5F454E44)
TOP = 5
FOLDS, FOLD = 7, 2
CHUNK_TOKENS = 1_600_000
BUCKET_TOKENS = 2_200_000


def learns(doc_id):
    """Rows the model learns from: crc32 of the id as text, modulo 7, is not 2 (NULL: of '')."""
    return F.crc32(F.coalesce(doc_id.cast('string'), F.lit(''))) % FOLDS != FOLD


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, contexts, document) of all tokens."""
    hashes, bounds = word_hashes(*buffer_of(texts))
    docs = len(bounds) - 1
    counts = np.diff(bounds)
    place = np.arange(docs)
    words = np.empty(len(hashes) + docs, np.uint64)
    inner = np.ones(len(words), bool)
    inner[bounds[1:] + place] = False
    words[inner] = hashes
    words[~inner] = END
    contexts = np.empty_like(words)
    contexts[1:] = words[:-1]
    contexts[bounds[:-1] + place] = START
    return words, contexts, np.repeat(place, counts + 1)


def token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for run in slices(batch, 'text'):
            yield run, *tokens(run.column('text'))


def runs_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values starts."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def small(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype('<u1' if top < 1 << 8 else '<u2' if top < 1 << 16 else '<u4').tobytes()


def unsmall(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f'<u{len(data) // n}').astype(np.int64)


@dataclass(frozen=True)
class Spread:
    """The number of buckets and the frequent words, sorted, with their counts in training."""
    buckets: int
    words: np.ndarray
    counts: np.ndarray

    def frequent(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is one, its place)."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return self.words[at] == words, at

    def bucket(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        many, _ = self.frequent(words)
        key = np.where(many, mixed(words ^ mixed(contexts)), words)
        return ((key >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)


def spread_of(docs: DataFrame, bucket_tokens: int = BUCKET_TOKENS) -> tuple[Spread, dict[str, int]]:
    """How to deal out (text, learn), and the totals of the corpus: tokens, documents, both also of training.

    A word is frequent if slices in which it is at least a quarter of a bucket's share hold half such
    a share of all tokens. Two passes over the texts, of which the driver gets counts of frequent
    words alone.
    """
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, own, rows, learn = 0, 0, 0, 0
        for run, words, _, doc in token_runs(batches):
            flags = run.column('learn').to_numpy(zero_copy_only=False)
            all_, own = all_ + len(words), own + int(flags[doc].sum())
            rows, learn = rows + run.num_rows, learn + int(flags.sum())
        yield pa.RecordBatch.from_pydict({'tokens': [all_], 'own': [own], 'docs': [rows], 'learn': [learn]})

    sums = docs.mapInArrow(totals, 'tokens bigint, own bigint, docs bigint, learn bigint').agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ('tokens', 'own', 'docs', 'learn')]).first().asDict()
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sums['tokens'] // bucket_tokens))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, _, _ in token_runs(batches):
            words = np.sort(words)
            at = runs_of(words)
            n = np.diff(np.append(at, len(words)))
            many = n * 4 * buckets >= len(words)
            yield pa.RecordBatch.from_arrays([pa.array(words[at][many].view(np.int64)), pa.array(n[many])], names=['word', 'n'])

    found = (docs.mapInArrow(candidates, 'word bigint, n bigint').groupBy('word').agg(F.sum('n').alias('n'))
             .filter(F.col('n') * 2 * buckets >= sums['tokens']).select('word').collect())
    frequent = np.unique(np.array([r.word for r in found] + [int(END.astype(np.int64))], np.int64).view(np.uint64))
    empty = Spread(buckets, frequent, np.zeros(len(frequent), np.int64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(frequent), np.int64)
        for run, words, _, doc in token_runs(batches):
            is_one, at = empty.frequent(words[run.column('learn').to_numpy(zero_copy_only=False)[doc]])
            n += np.bincount(at[is_one], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=['place', 'n'])

    counts = np.zeros(len(frequent), np.int64)
    for r in docs.mapInArrow(exact, 'place bigint, n bigint').groupBy('place').agg(F.sum('n').alias('n')).collect():
        counts[r.place] = r.n
    return Spread(buckets, frequent, counts), sums


BLOCK = ('bucket int, base bigint, ids array<bigint>, learn array<boolean>, n bigint, words binary, runs binary, '
         'contexts binary, context binary, doc binary, times binary')
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(', ')]


def postings(docs: DataFrame, spread: Spread) -> DataFrame:
    """Blocks of postings: one row per bucket and chunk of tokens, and one row per run of documents with their ids.

    Documents are numbered within the task. In a block, words and contexts stand once each; ``doc`` is
    twice the document's place plus one if it is learnt from.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        held, waiting, first = [], 0, base
        for piece, words, contexts, doc in token_runs(batches):
            learn = piece.column('learn')
            yield _rows([(int(base % spread.buckets), base, piece.column('doc_id').to_pylist(), learn.to_pylist(),
                          0, None, None, None, None, None, None)])
            doc = (doc + (base - first)) * 2 + learn.to_numpy(zero_copy_only=False)[doc]
            base += piece.num_rows
            for at in range(0, len(words), CHUNK_TOKENS):
                end = at + CHUNK_TOKENS
                held.append((words[at:end], contexts[at:end], doc[at:end]))
                waiting += len(held[-1][0])
                if waiting >= CHUNK_TOKENS:
                    yield from _blocks(held, first, spread)
                    held, waiting = [], 0
            if not held:
                first = base
        if held:
            yield from _blocks(held, first, spread)

    return docs.mapInArrow(run, BLOCK)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=BLOCK_NAMES)


def _blocks(held: list[tuple], first: int, spread: Spread) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*held)]
    held.clear()
    columns.append(spread.bucket(columns[0], columns[1]).astype(np.int32))
    order = np.lexsort((columns[2], columns[1], columns[0], columns[3]))
    for i in range(len(columns)):
        columns[i] = columns[i][order]
    del order
    words, contexts, doc, bucket = columns
    at = runs_of(bucket, words, contexts, doc)
    times = np.diff(np.append(at, len(words)))
    columns.clear()
    words, contexts, doc, bucket = words[at], contexts[at], doc[at], bucket[at]
    edges = np.append(runs_of(bucket), len(bucket))
    for a, b in zip(edges[:-1], edges[1:]):
        start = runs_of(words[a:b])
        table, place = np.unique(contexts[a:b], return_inverse=True)
        yield _rows([(int(bucket[a]), first, None, None, int(b - a), words[a:b][start].tobytes(),
                      small(np.diff(np.append(start, b - a))), table.tobytes(), small(place), small(doc[a:b]),
                      small(times[a:b]))])


TABLE = 'kind string, a bigint, b bigint, n bigint, x double, y double, r array<int>'


def tables(blocks: DataFrame, spread: Spread) -> DataFrame:
    """What the buckets know, by kind:

    ``id``: a document's number (a), doc_id (b), whether it is learnt from (n).
    ``doc``: a document's (a) tokens (n), x = sum of log10(c(w) + 1), y = sum over seen pairs above ``TOP`` of
    log10 of the count and over unseen pairs of log10(c(w) + 1), r = tokens with a known word, unseen pairs,
    pairs seen 1, ..., TOP times.
    ``unseen``: context (a), document (b), times (n).
    ``pair``: word (a), context (b), count (n).
    ``context``: context (a), b = sum of c(w) + 1 over its words, n = its count, r = words seen 1, ..., TOP times
    and the count of pairs above.
    ``stat``: number (n) of pairs seen a times; for a = 0 the number of distinct words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in BLOCK_NAMES}
                if row['ids'] is not None:
                    k = len(row['ids'])
                    yield _table('id', np.arange(k) + row['base'], row['ids'], np.array(row['learn'], np.int64))
                else:
                    held.setdefault(row['bucket'], []).append(row)
        for rows in held.values():
            yield from _counted(rows, spread)

    return blocks.repartitionById(spread.buckets, F.col('bucket')).mapInArrow(run, TABLE)


def _table(kind: str, a, b=None, n=None, x=None, y=None, r: np.ndarray | None = None) -> pa.RecordBatch:
    size = len(a)
    lists = pa.nulls(size, pa.list_(pa.int32())) if r is None else pa.ListArray.from_arrays(
        np.arange(0, r.size + 1, r.shape[1], dtype=np.int32), r.astype(np.int32).ravel())
    whole = [pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in
             zip((a, b, n, x, y), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.string()), *whole, lists],
                                      names=['kind', 'a', 'b', 'n', 'x', 'y', 'r'])


def _counted(rows: list[dict], spread: Spread) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[], [], [], [], []]
    while rows:
        row = rows.pop()
        n = row['n']
        doc, times = unsmall(row['doc'], n), unsmall(row['times'], n).astype(np.int32)
        table = np.frombuffer(row['words'], np.uint64)
        for column, part in zip(columns, (
                np.repeat(table, unsmall(row['runs'], len(table))),
                np.frombuffer(row['contexts'], np.uint64)[unsmall(row['context'], n)],
                row['base'] + (doc >> 1), (doc & 1).astype(np.int32) * times, times)):
            column.append(part)
    for i, parts in enumerate(columns):  # one column at a time: the parts of a bucket are its largest data
        columns[i] = np.concatenate(parts)
        parts.clear()
    order = np.lexsort((columns[1], columns[0]))
    for i in range(len(columns)):
        columns[i] = columns[i][order]
    words, contexts, doc, learnt, times = columns
    columns.clear()
    del order
    pair_at, word_at = runs_of(words, contexts), runs_of(words)
    pair_n, word_n = np.add.reduceat(learnt, pair_at), np.add.reduceat(learnt, word_at).astype(np.int64)
    del learnt
    many, place = spread.frequent(words[word_at])
    known = int(((word_n > 0) & ~many).sum())
    word_n = np.where(many, spread.counts[place], word_n)
    cw = np.repeat(word_n, np.diff(np.append(word_at, len(words))))
    cp = np.repeat(pair_n, np.diff(np.append(pair_at, len(words))))
    open_ = cp == 0
    yield _table('unseen', contexts[open_].view(np.int64), doc[open_], times[open_])
    yield _per_document(doc, times, cw, cp)
    del doc, times, cp, open_
    seen = pair_n > 0
    words, contexts, cw, pair_n_seen = words[pair_at][seen], contexts[pair_at][seen], cw[pair_at][seen], pair_n[seen]
    yield _table('pair', words.view(np.int64), contexts.view(np.int64), pair_n_seen)
    del words
    yield _per_context(contexts, cw, pair_n_seen)
    counts = np.bincount(np.minimum(pair_n, TOP + 2), minlength=TOP + 3)
    yield _table('stat', np.arange(TOP + 2), n=np.concatenate([[known], counts[1:TOP + 2]]))


def _per_document(doc, times, cw, cp) -> pa.RecordBatch:
    docs = distinct(doc)
    own = np.searchsorted(docs, doc)
    total = lambda weights: np.bincount(own, weights, len(docs))
    whole = lambda weights: total(weights).astype(np.int64)
    logs = np.log10(cw + 1.0)
    logs *= times
    x = total(logs)
    logs[cp > 0] = 0.0
    often = cp > TOP
    logs[often] = times[often] * np.log10(cp[often])
    r = np.stack([whole(times * (cw > 0)), *[whole(times * (cp == k)) for k in range(TOP + 1)]], 1)
    return _table('doc', docs, n=whole(times), x=x, y=total(logs), r=r)


def _per_context(contexts, cw, n) -> pa.RecordBatch:
    order = np.argsort(contexts, kind='stable')
    contexts, cw, n = contexts[order], cw[order], n[order]
    at = runs_of(contexts)
    if not len(contexts):
        return _table('context', [], [], [], r=np.zeros((0, TOP + 1)))
    total = lambda x: np.add.reduceat(x.astype(np.int64), at)
    r = np.stack([*[total(n == k) for k in range(1, TOP + 1)], total(n * (n > TOP))], 1)
    return _table('context', contexts[at].view(np.int64), total(cw + 1), total(n), r=r)


def discounts(counts: dict[int, int], top: int = TOP) -> list[float]:
    """Discounted counts for 1, ..., top from the number of pairs seen r times (Katz's form of Good-Turing).

    Where the formula gives none between 0 and the count, as with very few pairs, half a count is
    taken off.
    """
    out = []
    n = lambda r: counts.get(r, 0)
    common = (top + 1) * n(top + 1) / n(1) if n(1) else 1.0
    for r in range(1, top + 1):
        ratio = ((r + 1) * n(r + 1) / (r * n(r)) - common) / (1 - common) if n(r) and common < 1 else 0.0
        out.append(r * ratio if 0 < ratio < 1 else r - 0.5)
    return out


def score(docs: DataFrame, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Needs doc_id and text; other columns are left out. NULL and empty texts are the end token alone.
    Repeated rows are rows of their own, in training too. Without training rows nothing is known and
    every token has probability 1 / (0 + 0 + 1). The tables stay in the shared folder, by kind.
    """
    own = docs.select(doc_id(), whole_text().alias('text'), learns(F.col('doc_id')).alias('learn'))
    spread, sums = spread_of(own, bucket_tokens)
    model = stored(tables(postings(own, spread), spread), 'katz', 'kind')
    kind = lambda k: model.filter(F.col('kind') == k)
    stat = {r.a: r.n for r in kind('stat').groupBy('a').agg(F.sum('n').alias('n')).collect()}
    vocabulary = stat.get(0, 0) + int((spread.counts > 0).sum())
    whole = float(sums['own'] + vocabulary + 1)
    cut = discounts(stat)
    left = 1 - (sum(F.col(f'm{k}') * F.lit(cut[k]) for k in range(TOP)) + F.col(f'm{TOP}')) / (F.col('n') + 1)
    weights = (kind('context').groupBy(F.col('a').alias('context'))
               .agg(F.sum('n').alias('n'), F.sum('b').alias('b'),
                    *[F.sum(F.get('r', F.lit(k))).alias(f'm{k}') for k in range(TOP + 1)])
               .select('context', 'n', (left / (1 - F.col('b') / F.lit(whole))).alias('weight')))
    weights = stored(weights, 'katz-weights')
    backed = (kind('unseen').groupBy(F.col('a').alias('context'), F.col('b').alias('doc')).agg(F.sum('n').alias('times'))
              .join(weights, 'context')
              .select('doc', (F.col('times') * F.log10((F.col('n') + 1) * F.col('weight'))).alias('back')))
    parts = (kind('doc').select(F.col('a').alias('doc'), 'n', 'x', 'y', *[F.get('r', F.lit(k)).alias(f'r{k}') for k in range(TOP + 2)])
             .unionByName(backed, allowMissingColumns=True)
             .unionByName(kind('id').select(F.col('a').alias('doc'), F.col('b').alias('doc_id'), (F.col('n') == 1).alias('learn')),
                          allowMissingColumns=True))
    summed = parts.groupBy('doc').agg(
        F.max('doc_id').alias('doc_id'), F.max('learn').alias('learn'), F.sum('n').alias('n'), F.sum('x').alias('x'),
        F.sum('y').alias('y'), F.coalesce(F.sum('back'), F.lit(0.0)).alias('back'),
        *[F.sum(f'r{k}').alias(f'r{k}') for k in range(TOP + 2)])
    seen = sum(F.col(f'r{k + 2}') * F.lit(float(np.log10(cut[k]))) for k in range(TOP))
    unit = float(np.log10(whole))
    return summed.select(
        'doc_id', (~F.col('learn')).alias('held_out'), F.col('n').alias('n_tokens'), F.col('r0').alias('n_known'),
        F.lit(sums['own']).cast('bigint').alias('train_tokens'), (F.col('x') - F.col('n') * unit).alias('base_score'),
        (F.col('y') + seen - F.col('r1') * unit - F.col('x') + F.col('back')).alias('score'))


@query('op1_katz_backoff')
def op1_katz_backoff(spark, sf_dir):
    return score(documents(spark, sf_dir))
