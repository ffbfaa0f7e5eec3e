"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct word shingles; two are linked if the sets' Jaccard similarity
reaches a threshold. The signature has one b-bit value (b = 8) per minhash; the distance of two
signatures is the number of values that differ.

1. Signatures are cut into ``chunks`` of ``slots`` values. By the pigeonhole principle two signatures
   with a distance of at most ``2 * chunks - 1`` have a chunk with at most one wrong value. Each chunk
   is indexed once per slot with that slot left out, so every such pair meets under a key. No bucket
   is capped.
2. Within a key, distances are compared in blocks of bounded size, and only links that join two
   groups are written: a forest, not all pairs. Its components are clusters of candidates.
3. Every cluster is checked on the full shingle sets, again in blocks: two sets not yet in one group
   are compared exactly. The verified forest gives the components.

Equal signatures are indexed once, and equal shingle sets are compared once, however many copies
there are. Texts are read twice; only those of candidate clusters leave their task, as shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codefindings.llm.common import doc_id, documents, join_by_key, stored, whole_text
from codefindings.llm.components import components
from codefindings.llm.registry import query
from codefindings.llm.words import buffer_of, distinct, mixed, shingle_hashes, slices, word_hashes


@dataclass(frozen=True)
class Likeness:
    """``100 * intersection >= percent * union`` over sets of ``width``-word shingles.

    ``slack`` extra distance is tolerated in step 2: keys already bring such pairs together.
    """
    width: int = 5
    percent: int = 80
    chunks: int = 8
    slots: int = 5
    slack: int = 4

    @property
    def values(self) -> int:
        return self.chunks * self.slots

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1 + self.slack


CONTRACT = Likeness(width=3, percent=85, chunks=7, slots=6, slack=4)
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1 << 20
BROADCAST_ROWS = 200_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    shingles, bounds = shingle_hashes(*word_hashes(*buffer_of(texts)), width)
    return [distinct(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def digest_of(shingles: np.ndarray) -> str:
    """128 bits that name a set."""
    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """(documents, values) bytes; the low byte of every minhash. Sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), values), np.uint8)
    for i in range(values):
        salt = np.uint64((0xA0761D6478BD642F * (2 * i + 1)) & ((1 << 64) - 1))
        odd = np.uint64((0xE7037ED1A0B428DB * (2 * i + 1)) & ((1 << 64) - 1))
        hashed = (flat ^ salt) * odd
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = mixed(np.minimum.reduceat(hashed, starts)).astype(np.uint8)
    return out


def sketched(docs: DataFrame, how: Likeness) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, signature), the signature NULL for empty sets."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, 'text'):
                sets = shingle_sets(run.column('text'), how.width)
                full = [i for i, s in enumerate(sets) if len(s)]
                made = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], how.values)):
                        made[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([
                    run.column('doc_id'), run.column('text_hash'), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest_of(s) for s in sets]), pa.array(made, pa.binary())],
                    names=['doc_id', 'text_hash', 'n_shingles', 'digest', 'signature'])

    return (docs.select(doc_id(), F.xxhash64(whole_text()).alias('text_hash'), whole_text().alias('text'))
            .mapInArrow(sketch, 'doc_id bigint, text_hash bigint, n_shingles bigint, digest string, signature binary'))


class Forest:
    """Groups of numbered things; remembers the links that joined two groups."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((int(i), int(j)))

    def flat(self) -> np.ndarray:
        """The root of everything."""
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def blocks(size, rows: int, group: str, member: str, per_block) -> list:
    """Columns (bucket, ...) that deal a group's members to pairs of blocks.

    A group of several blocks becomes one bucket per pair of blocks; a member goes to all pairs that
    contain its block.
    """
    parts = F.greatest(F.lit(1), F.ceil(size / F.lit(per_block))).cast('int')
    mine = F.pmod(F.xxhash64(member, F.lit(17)), parts).cast('int')
    others = F.sequence(F.lit(0), parts - 1)
    return F.explode(F.transform(others, lambda o: F.xxhash64(F.col(group), F.least(o, mine), F.greatest(o, mine))))


def candidate_links(nodes: DataFrame, how: Likeness) -> DataFrame:
    """(a, b): a forest that connects all ``nodes`` (node, signature) within the distance."""
    keys = []
    for c in range(how.chunks):
        for out in range(how.slots):
            first = c * how.slots + 1
            keys.append(F.xxhash64(F.lit(c * how.slots + out), F.substring('signature', first, out),
                                   F.substring('signature', first + out + 1, how.slots - out - 1)))
    spread = nodes.select('node', F.explode(F.array(*keys)).alias('key'))
    sizes = spread.groupBy('key').agg(F.count(F.lit(1)).alias('n')).filter('n > 1')
    met = (spread.join(sizes, 'key')
           .select('node', blocks(F.col('n'), BLOCK_ROWS, 'key', 'node', BLOCK_ROWS).alias('bucket')))
    rows = met.join(nodes, 'node').select('bucket', 'node', 'signature')

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, signature in whole_groups(batches, how.values):
            names, number = np.unique(node, return_inverse=True)
            forest = Forest(len(names))
            change = np.flatnonzero(np.diff(bucket)) + 1
            ends = np.repeat(np.append(change, len(bucket)), np.diff(np.concatenate([[0], change, [len(bucket)]])))
            at = np.arange(len(bucket))
            step = 1
            while len(at := at[at + step < ends[at]]):
                for some in np.array_split(at, -(-len(at) // 8192)):
                    roots = forest.flat()
                    some = some[roots[number[some]] != roots[number[some + step]]]
                    near = (signature[some] != signature[some + step]).sum(1) <= how.distance
                    for i in some[near]:
                        forest.join(number[i], number[i + step])
                step += 1
            if forest.links:
                a, b = np.array(forest.links).T
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=['a', 'b'])

    return rows.repartition('bucket').sortWithinPartitions('bucket', 'node').mapInArrow(link, 'a bigint, b bigint')


def whole_groups(batches, values: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole buckets of at least one batch."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column('bucket').to_numpy()
        rows = (bucket, batch.column('node').to_numpy(),
                np.frombuffer(b''.join(batch.column('signature').to_pylist()), np.uint8).reshape(-1, values))
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut or (held and held[-1][0][-1] != bucket[-1]):
            held.append(tuple(r[:cut] for r in rows))
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []
        held.append(tuple(r[cut:] for r in rows))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def verified_links(docs: DataFrame, members: DataFrame, how: Likeness) -> DataFrame:
    """(a, b): digests of sets in one cluster; a forest over all pairs that reach the threshold.

    ``members`` (id, text_hash, digest, cluster, weight) names one document per set. It goes to the
    texts as a broadcast if it has at most ``BROADCAST_ROWS`` rows; beyond that whole texts are shuffled to it,
    as they are at a hundred times the size of the tests.
    """
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = docs.select(doc_id(), F.xxhash64(whole_text()).alias('_hash'), whole_text().alias('text'))
    chosen = (texts.join(members, F.col('doc_id').eqNullSafe(F.col('id')) & (F.col('_hash') == F.col('text_hash')))
              .select('digest', 'cluster', 'weight', 'text'))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set = set()
        for batch in batches:
            for run in slices(batch, 'text'):
                made, names = shingle_sets(run.column('text'), how.width), run.column('digest').to_pylist()
                keep = [i for i, s in enumerate(made) if digest_of(s) == names[i] and names[i] not in last]
                last = {names[i] for i in keep}
                if keep:
                    rows = run.select(['digest', 'cluster', 'weight']).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([made[i].tobytes() for i in keep], pa.binary())],
                                                     names=['digest', 'cluster', 'weight', 'shingles'])

    dealt = (chosen.mapInArrow(sets, 'digest string, cluster bigint, weight double, shingles binary')
             .select('digest', 'shingles', blocks(F.col('weight'), 1, 'cluster', 'digest', 1.0).alias('bucket')))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        now, found = None, []
        for batch in batches:
            for bucket, digest, shingles in zip(*(batch.column(c) for c in ('bucket', 'digest', 'shingles'))):
                if bucket.as_py() != now:
                    found += linked(held, how.percent)
                    held, now = {}, bucket.as_py()
                held[digest.as_py()] = np.frombuffer(shingles.as_py(), np.uint64)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=['a', 'b'])
                found = []
        if found := linked(held, how.percent):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=['a', 'b'])

    return dealt.repartition('bucket').sortWithinPartitions('bucket').mapInArrow(check, 'a string, b string')


def linked(sets: dict[str, np.ndarray], percent: int) -> list[tuple[str, str]]:
    """A forest over the pairs of sets with ``100 * intersection >= percent * union``.

    Shared shingles are counted from an index of the shingles that two sets or more have, one set
    against all later ones; pairs already in one group are not looked at.
    """
    if len(sets) < 2:
        return []
    names = sorted(sets, key=lambda d: (len(sets[d]), d))
    sizes = np.array([len(sets[d]) for d in names])
    forest = Forest(len(names))
    if len(names) == 2:
        a, b = sets[names[0]], sets[names[1]]
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return [(names[0], names[1])] if 100 * both >= percent * (len(a) + len(b) - both) else []
    flat = np.concatenate([sets[d] for d in names])
    owner = np.repeat(np.arange(len(names)), sizes)
    order = np.argsort(flat, kind='stable')
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])
    run = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = first[1:][run]
    by_owner = np.argsort(owner, kind='stable')
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(names) - 1):
        own = by_owner[starts[i]:starts[i + 1]]
        counts = ends[own] - own - 1
        total = int(counts.sum())
        if not total:
            continue
        shift = np.repeat(own + 1 - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        both = np.bincount(owner[shift + np.arange(total)], minlength=len(names))
        union = sizes[i] + sizes - both
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * union)):
            forest.join(i, int(j))
    return [(names[i], names[j]) for i, j in forest.links]


def groups(docs: DataFrame, how: Likeness) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, group) for every row of ``docs``; needs doc_id and text.

    ``group`` names the component of the document's set; rows with empty sets (NULL, empty and blank
    texts) have none. Repeated rows, ties and NULL ids are rows like any other.
    """
    rows = stored(sketched(docs, how), 'near-rows')
    full = rows.filter('signature IS NOT NULL')
    classes = stored(full.groupBy('digest').agg(
        F.min(F.struct(F.col('doc_id').isNull(), F.col('doc_id').alias('id'), 'text_hash')).alias('one'),
        F.first('n_shingles').alias('n_shingles'), F.first('signature').alias('signature'), F.count(F.lit(1)).alias('copies'))
        .select('digest', 'one.id', 'one.text_hash', 'n_shingles', 'signature', 'copies', F.xxhash64('signature').alias('node')),
        'near-classes')
    nodes = classes.select('node', 'signature').dropDuplicates(['node'])
    near = components(candidate_links(nodes, how))
    placed = stored(classes.drop('signature', 'copies').join(near, 'node', 'left')
                    .withColumn('cluster', F.coalesce('component', 'node')).drop('component', 'node'), 'near-placed')
    weights = (placed.groupBy('cluster').agg(F.count(F.lit(1)).alias('n'), F.sum('n_shingles').alias('total'))
               .filter('n > 1')
               .select(F.col('cluster').alias('_cluster'), 'n', F.greatest(F.col('n') / BLOCK_ROWS, F.col('total') / BLOCK_SHINGLES).alias('weight')))
    members = stored(join_by_key(placed, stored(weights, 'near-weights'), 'cluster', '_cluster', 'n').select('id', 'text_hash', 'digest', 'cluster', 'weight'),
                     'near-members')
    joined = components(verified_links(docs, members, how))
    named = stored(classes.select(F.col('digest').alias('_digest'), 'copies')
                   .join(joined.withColumnRenamed('node', '_node'), F.col('_digest') == F.col('_node'), 'left')
                   .select('_digest', 'copies', F.coalesce('component', '_digest').alias('group')), 'near-named')
    rows = rows.drop('signature')
    placed_rows = join_by_key(rows.filter('n_shingles > 0'), named, 'digest', '_digest', 'copies').drop('copies')
    return placed_rows.unionByName(rows.filter('n_shingles = 0'), allowMissingColumns=True)


def with_group_facts(rows: DataFrame, *facts: Column) -> DataFrame:
    """``rows`` that have a group, with facts aggregated over it; rows of large groups stay where they are."""
    per_group = stored(rows.groupBy(F.col('group').alias('_group')).agg(*facts, F.count(F.lit(1)).alias('n')), 'near-facts')
    return join_by_key(rows, per_group, 'group', '_group', 'n')


def near_duplicates(docs: DataFrame, how: Likeness) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own for empty sets; NULL ids
    count last, so it is NULL only if all ids of the component are. ``kept``: the row has that id.
    """
    rows = stored(groups(docs, how), 'near-groups')
    grouped = with_group_facts(rows.filter('group IS NOT NULL'), F.min('doc_id').alias('component_id')).drop('n')
    alone = rows.filter('group IS NULL').withColumn('component_id', F.col('doc_id'))
    return grouped.unionByName(alone).select('doc_id', 'n_shingles', 'component_id',
                                             F.col('doc_id').eqNullSafe(F.col('component_id')).alias('kept'))


def one_of_each(docs: DataFrame, how: Likeness) -> DataFrame:
    """``docs`` with one row of each group: the smallest (doc_id, text); all columns kept.

    NULL ids come last. Rows with empty sets are kept, as they are linked with nothing. Rows to go
    are looked up by id and digest of the text: by broadcast if there are at most ``BROADCAST_ROWS``.
    Of rows equal in id and text one stays, whatever their other columns say.
    """
    rows = stored(groups(docs, how).filter('group IS NOT NULL'), 'near-groups')
    who = F.struct(F.col('doc_id').isNull(), F.col('doc_id').alias('id'), F.col('text_hash').alias('hash'))
    crowd = with_group_facts(rows, F.min(who).alias('best')).filter('n > 1')
    same = F.col('doc_id').eqNullSafe(F.col('best.id')) & (F.col('text_hash') == F.col('best.hash'))
    leave = stored(crowd.groupBy(F.col('doc_id').alias('_id'), F.col('text_hash').alias('_hash'))
                   .agg(F.bool_and(same).alias('_stays'), F.count(F.lit(1)).alias('_n'))
                   .filter('NOT _stays OR _n > 1'), 'near-leave')
    if leave.count() <= BROADCAST_ROWS:
        leave = F.broadcast(leave)
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias('_row')).join(
        leave, F.col('_row.doc_id').eqNullSafe(F.col('_id'))
        & (F.xxhash64(F.coalesce('_row.text', F.lit(''))) == F.col('_hash')), 'left')
    single = marked.filter('_stays IS NULL').select('_row.*')
    repeated = marked.filter('_stays').dropDuplicates(['_id', '_hash']).select('_row.*')
    return single.unionAll(repeated)


@query('op5_near_duplicates')
def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), CONTRACT)
