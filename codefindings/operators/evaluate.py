"""Scoring predictions against ground truth: greedy one-to-one matching, precision and recall."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codefindings.functions.text import normalize_type
from codefindings.operators.ordered import position, previous, running_sum
from codefindings.sources.scratch import checkpointed

TOLERANCE = 1
#: Rows of an island that one task solves; lines per bucket when gaps are looked for.
ISLAND_ROWS = 200_000
LINE_BUCKET = 10_000


def _suffixes(column):
    """All suffixes of a name, the empty one included."""
    return F.transform(F.sequence(F.lit(1), F.length(column) + 1),
                       lambda i: F.substring(column, i, F.length(column)))


def file_pairs(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(pred_file, truth_file) where the names are equal or one ends with the other.

    Works on distinct names with equality joins on suffixes, so no name is compared with all others.
    """
    pred = predictions.select(F.col('file').alias('pred_file')).distinct()
    gold = truth.select(F.col('file').alias('truth_file')).distinct()
    longer_pred = pred.withColumn('truth_file', F.explode(_suffixes(F.col('pred_file')))).join(
        gold, 'truth_file', 'left_semi')
    longer_gold = gold.withColumn('pred_file', F.explode(_suffixes(F.col('truth_file')))).join(
        pred, 'pred_file', 'left_semi')
    return longer_pred.select('pred_file', 'truth_file').union(
        longer_gold.select('pred_file', 'truth_file')).distinct()


def _reach(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Truth rows under every (file, type, line) at which a prediction would match them."""
    near = F.array(*[F.col('line') + d for d in range(-TOLERANCE, TOLERANCE + 1)])
    return (truth.withColumn('line', F.explode(near)).withColumnRenamed('file', 'truth_file')
            .join(pairs, 'truth_file').withColumnRenamed('pred_file', 'file').drop('truth_file'))


def normalized(df: DataFrame) -> DataFrame:
    return df.withColumn('type', normalize_type(F.col('type')))


def unmatched(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions that match no truth row at all, used or not."""
    predictions, truth = normalized(predictions), normalized(truth)
    places = _reach(truth, file_pairs(predictions, truth)).select('file', 'type', 'line').distinct()
    return predictions.join(places, ['file', 'type', 'line'], 'left_anti')


def _families(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(file, family): names of which one ends with the other have one family, their shortest common end that is a name.

    Of two names that both end a third one, one ends the other, so the shortest ending name is the same for all.
    """
    names = predictions.select('file').union(truth.select('file')).distinct()
    ends = names.withColumn('end', F.explode(_suffixes(F.col('file'))))
    return (ends.join(names.select(F.col('file').alias('end')), 'end').groupBy('file')
            .agg(F.min_by('end', F.length('end')).alias('family')))


def islands(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Both inputs as (type, family, island, side, file, line, ord): rows of different islands never match.

    An island is a run of lines without a gap in one type and family of files; ``side`` is 0 for truth.
    """
    sides = (truth.select(F.lit(0).alias('side'), 'file', 'type', 'line', F.col('ord').alias('truth_ord'))
             .unionByName(predictions.select(F.lit(1).alias('side'), 'file', 'type', 'line', 'ord'), allowMissingColumns=True)
             .filter('file IS NOT NULL AND type IS NOT NULL AND line IS NOT NULL'))
    rows = sides.join(_families(predictions, truth), 'file')
    own = ['type', 'family']
    lines = rows.select(*own, F.col('line').cast('bigint').alias('line')).distinct()
    starts = F.coalesce((F.col('line') - F.col('_before') > TOLERANCE).cast('int'), F.lit(1))
    numbered = running_sum(previous(lines, own, 'line', '_before', bucket=LINE_BUCKET).select(*own, 'line', starts.alias('_starts')),
                           own, ['line'], F.col('_starts'), 'island').drop('_starts')
    return rows.join(numbered, [*own, 'line'])


def match(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(ord, truth_ord): each prediction, in order, takes the first unused truth row it matches.

    Both inputs need file, type, line and a unique ``ord``; a NULL in one of the first three matches nothing.
    The rows are cut into islands that cannot compete, and each island is solved by the greedy loop in one
    pass, in a fixed number of stages whatever its length. An island of more than ``ISLAND_ROWS`` rows, too
    many for one task, is solved in distributed rounds instead, with the same result.
    """
    predictions, truth = normalized(predictions), normalized(truth)
    own = ['type', 'family', 'island']
    rows = checkpointed(islands(predictions, truth))
    sizes = rows.groupBy(*own).agg(F.count(F.lit(1)).alias('n'), F.min('side').alias('a'), F.max('side').alias('b')).filter('a < b')
    rows = rows.join(sizes.select(*own, 'n'), own)
    parts = int(rows.sparkSession.conf.get('spark.sql.shuffle.partitions'))
    # Dealt by a hash of the island, not by its columns: the join above is dealt by those, so Spark would leave this
    # shuffle out and might then read the join's rows by mapper, which tears islands apart.
    dealt = (rows.filter(F.col('n') <= ISLAND_ROWS).select(*own, 'side', 'file', 'line', 'ord', 'truth_ord')
             .repartition(parts, F.xxhash64(*own)).sortWithinPartitions(*own, 'side', 'truth_ord', 'ord'))
    kinds = dict(dealt.dtypes)
    matched = dealt.mapInArrow(_greedy, f"ord {kinds['ord']}, truth_ord {kinds['truth_ord']}")
    large = checkpointed(rows.filter(F.col('n') > ISLAND_ROWS))
    if large.isEmpty():
        return matched
    return matched.unionByName(in_rounds(large.filter('side = 1').select('file', 'type', 'line', 'ord'),
                                         large.filter('side = 0').select('file', 'type', 'line', F.col('truth_ord').alias('ord'))))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy loop over rows sorted by island, truth first, each side in order. All truth of one place is alike."""
    now, waiting, fits = None, {}, {}
    for batch in batches:
        pairs = []
        for *island, side, file, line, ord_, truth_ord in zip(*(c.to_pylist() for c in batch.columns)):
            if island != now:
                now, waiting, fits = island, {}, {}
            if side == 0:
                waiting.setdefault(file, {}).setdefault(line, deque()).append(truth_ord)
                continue
            if file not in fits:
                fits[file] = [places for other, places in waiting.items() if file.endswith(other) or other.endswith(file)]
            open_ = [q for places in fits[file] for d in range(-TOLERANCE, TOLERANCE + 1) if (q := places.get(line + d))]
            if open_:
                pairs.append((ord_, min(open_, key=lambda q: q[0]).popleft()))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], batch.schema.field(n).type) for i, n in enumerate(('ord', 'truth_ord'))],
                                         names=['ord', 'truth_ord'])


def in_rounds(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """What :func:`match` returns, for islands of any size; types are normalized already.

    The greedy result is the stable matching in which both sides prefer the smallest ``ord``, so it can be
    computed in rounds: every prediction proposes to the next truth row on its list, a truth row keeps its
    earliest proposer, the others move on. Predictions with the same list start one place apart, because
    the earlier ones must have taken (or passed) the places before. Lists are shared by all predictions at
    the same place, so candidate pairs are never built. Rounds end when nobody is turned away.
    """
    place = ['file', 'type', 'line']
    reach = _reach(truth, file_pairs(predictions, truth)).withColumnRenamed('ord', 'truth_ord')
    wanted = predictions.select(*place).distinct()
    lists = position(reach.join(wanted, place, 'left_semi').select(*place, 'truth_ord'),
                     place, ['truth_ord'], 'pos')
    lengths = lists.groupBy(*place).agg(F.max('pos').alias('length'))
    # Of all predictions at one place at most as many as the list is long can be matched: the first.
    ranked = position(predictions.join(lengths.drop('length'), place, 'left_semi')
                      .select('ord', *place), place, ['ord'], 'pos')
    state = checkpointed(ranked.join(lengths, place).filter('pos <= length').drop('length'))
    lists = checkpointed(lists)
    while True:
        offers = state.join(lists, [*place, 'pos'])
        keeps = offers.groupBy('truth_ord').agg(F.min('ord').alias('holder'))
        judged = offers.join(keeps, 'truth_ord').withColumn('lost', F.col('ord') != F.col('holder'))
        judged = checkpointed(judged.select('ord', *place, 'pos', 'truth_ord', 'lost'))
        if judged.filter('lost').isEmpty():
            return judged.select('ord', 'truth_ord')
        # Those past the end of their list find no offer in the next round and drop out unmatched.
        state = judged.select('ord', *place, (F.col('pos') + F.col('lost').cast('int')).alias('pos'))


def metrics(n_predictions: DataFrame, n_truth: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 (0 where the denominator is 0)."""
    def count(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))
    preds, gold = count(n_predictions, 'p'), count(n_truth, 'g')
    counts = count(matched, 'tp').select(
        'tp', (preds.scalar() - F.col('tp')).alias('fp'), (gold.scalar() - F.col('tp')).alias('fn'))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    tp, p, r = F.col('tp'), F.col('precision'), F.col('recall')
    return (counts.withColumn('precision', ratio(tp, tp + F.col('fp')))
            .withColumn('recall', ratio(tp, tp + F.col('fn')))
            .withColumn('f1', ratio(2 * p * r, p + r)))
