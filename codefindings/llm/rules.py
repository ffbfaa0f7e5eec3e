"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every document has a few statistics; a rule set rejects it if one of them exceeds its cutoff. Cutoffs
come in steps from lenient to strict: the quantiles of good documents of the tuning half of the
labels. The other half, the holdout, decides which step is taken: for each stratum, the steps are
tested in order, and a step passes if the exact binomial bound says that, at confidence
``1 - DELTA / strata``, the rule set rejects at most ``RISK`` of the good documents (Clopper-Pearson:
``P(X <= k | n, RISK) <= DELTA / strata`` for k of n holdout documents rejected). Testing stops at the
first step that fails, so no further correction is needed within a stratum, and with probability
``1 - DELTA`` the limit holds in all strata. A stratum with too few labels keeps all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codefindings.llm.common import WORD, documents, labels, stored, whole_text
from codefindings.llm.registry import query

RISK = 0.05
DELTA = 0.05
STEPS = [1.0, 0.999, 0.998, 0.995, 0.99, 0.985, 0.98, 0.975, 0.97, 0.96, 0.95]
BLANKS = ' \t\n\x0b\x0c\r'
SYMBOLS = '#*$%&|<>'
NAMES = ['symbols', 'exclamations', 'capitals', 'dup_lines', 'repeats', 'word_length']


def without(text: Column, characters: str) -> Column:
    """The number of code points of a text that are none of ``characters``."""
    return F.length(F.translate(text, characters, ''))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, marks).

    ``marks`` holds the statistics of ``NAMES`` as whole numbers from 0 to 1000. All arrays live in
    one row: a document is counted where it is read. A NULL text has no words.
    """
    words = F.array_remove(F.split('text', r'[\x20\x09-\x0D]+'), '')
    lines = F.filter(F.split('text', '\n'), lambda x: x.rlike(WORD))
    at = lambda i, k: F.get('words', i + k)
    windows = F.when(F.size('words') >= 3, F.transform(
        F.sequence(F.lit(0), F.size('words') - 3),
        lambda i: F.concat_ws(' ', at(i, 0), at(i, 1), at(i, 2)))).otherwise(F.array().cast('array<string>'))
    whole = (docs.select('doc_id', 'lang', whole_text().alias('text'))
             .withColumn('words', words).withColumn('lines', lines).withColumn('windows', windows))
    repeated = (F.size('windows') > F.size(F.array_distinct('windows')))
    base = whole.select(
        'doc_id', 'lang', F.size('words').cast('bigint').alias('n_words'),
        without(F.col('text'), BLANKS).cast('bigint').alias('word_chars'),
        (F.length('text') - without(F.col('text'), SYMBOLS)).cast('bigint').alias('n_symbols'),
        (F.length('text') - without(F.col('text'), '!')).cast('bigint').alias('_exclamations'),
        (F.length('text') - without(F.col('text'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')).cast('bigint').alias('_capitals'),
        F.size('lines').cast('bigint').alias('_lines'),
        (F.size('lines') - F.size(F.array_distinct('lines'))).cast('bigint').alias('n_dup_lines'),
        F.when(repeated, F.sort_array(F.transform('windows', lambda w, i: F.struct(w.alias('w'), i.alias('i')))))
        .alias('_sorted'))
    size = F.size('_sorted')
    twice = F.transform(
        F.filter(F.sequence(F.lit(0), size - 1), lambda k:
                 (F.get('_sorted', k)['w'] == F.coalesce(F.get('_sorted', k - 1)['w'], F.lit('')))
                 | (F.get('_sorted', k)['w'] == F.coalesce(F.get('_sorted', k + 1)['w'], F.lit('')))),
        lambda k: F.get('_sorted', k)['i'])
    placed = base.withColumn('_twice', F.when(F.col('_sorted').isNotNull(), F.sort_array(twice))).drop('_sorted')
    covered = F.aggregate(F.sequence(F.lit(1), F.size('_twice') - 1), F.lit(3),
                          lambda sum_, k: sum_ + F.least(F.lit(3), F.get('_twice', k) - F.get('_twice', k - 1)))
    full = placed.withColumn('n_repeat_words', F.when(F.col('_twice').isNotNull(), covered).otherwise(0).cast('bigint'))
    part = lambda a, b: F.floor(F.least(F.lit(1000.0), a * 1000 / F.greatest(F.lit(1), b))).cast('int')
    marks = F.array(part(F.col('n_symbols'), F.col('word_chars')), part(F.col('_exclamations'), F.col('word_chars')),
                    part(F.col('_capitals'), F.col('word_chars')), part(F.col('n_dup_lines'), F.col('_lines')),
                    part(F.col('n_repeat_words'), F.col('n_words')), part(F.col('word_chars') / 100, F.col('n_words')))
    return full.select(
        'doc_id', 'lang', 'n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words',
        ((F.col('n_words') < 50) | (100 * F.col('n_repeat_words') > 50 * F.col('n_words'))).alias('base_failed'),
        marks.alias('marks'))


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias('t'), F.lit(0.0).alias('s'))
    terms = F.aggregate(
        F.sequence(F.lit(0).cast('bigint'), k), start,
        lambda a, i: F.struct((a['t'] + F.log((n - i) / (i + 1)) + odds).alias('t'), (a['s'] + F.exp(a['t'])).alias('s')),
        lambda a: a['s'])
    return F.when(k >= n, 1.0).otherwise(terms)


def cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, step, cuts) from (doc_id, stratum, marks) of good documents; strata that pass no step are left out.

    ``cuts`` has one number per statistic; a document is rejected if a statistic exceeds it. NULL is a
    stratum of its own. The halves are told apart by the parity of crc32(doc_id as text).
    """
    half = F.crc32(F.coalesce(F.col('doc_id').cast('string'), F.lit(''))) % 2
    tuning, holdout = labelled.filter(half == 0), labelled.filter(half == 1)
    bins = (tuning.select('stratum', F.posexplode('marks').alias('rule', 'mark'))
            .groupBy('stratum', 'rule', 'mark').agg(F.count(F.lit(1)).alias('n')))
    own = Window.partitionBy('stratum', 'rule')
    running = bins.withColumn('upto', F.sum('n').over(own.orderBy('mark'))).withColumn('all', F.sum('n').over(own))
    ladder = (running.groupBy('stratum', 'rule')
              .agg(F.array(*[F.min(F.when(F.col('upto') >= F.lit(q) * F.col('all'), F.col('mark'))) for q in STEPS]).alias('cut'))
              .groupBy('stratum').agg(F.sort_array(F.collect_list(F.struct('rule', 'cut'))).alias('ladder'))
              .select(F.col('stratum').alias('_stratum'), 'ladder'))
    tried = (holdout.join(ladder, F.col('stratum').eqNullSafe(F.col('_stratum')))
             .select('stratum', 'marks', 'ladder', F.explode(F.sequence(F.lit(0), F.lit(len(STEPS) - 1))).alias('step'))
             .withColumn('cuts', F.expr('transform(ladder, r -> r.cut[step])'))
             .withColumn('out', F.expr('exists(zip_with(marks, cuts, (m, c) -> m > c), x -> x)')))
    counts = tried.groupBy('stratum', 'step').agg(
        F.sum(F.col('out').cast('bigint')).alias('k'), F.count(F.lit(1)).alias('n'), F.first('cuts').alias('cuts'))
    strata = counts.select('stratum').distinct().count()
    passed = binomial_below(F.col('k'), F.col('n'), risk) <= F.lit(delta / max(1, strata))
    order = Window.partitionBy('stratum').orderBy('step')
    return (counts.withColumn('ok', F.bool_and(passed).over(order)).filter('ok')
            .groupBy('stratum').agg(F.max(F.struct('step', 'cuts')).alias('last'))
            .select('stratum', 'last.step', 'last.cuts'))


def judge(docs: DataFrame, quality: DataFrame) -> DataFrame:
    """The counts of every row of ``docs`` with base_failed, kept and the cutoffs used.

    ``docs`` needs doc_id, text and lang, ``quality`` doc_id and quality; other columns are left out.
    Strata are the values of lang. Documents that fail the base rule are not kept; else a document is
    kept if no statistic exceeds its cutoff. NULL ids have no label. An empty table gives no rows, and
    without labels all that pass the base rule are kept.
    """
    stats = stored(counted(docs), 'rule-counts')
    good = quality.filter('quality = 1').select(F.col('doc_id').alias('_doc')).distinct()
    labelled = (stats.filter('NOT base_failed').join(good, F.col('doc_id') == F.col('_doc'))
                .select('doc_id', F.col('lang').alias('stratum'), 'marks'))
    chosen = stored(cutoffs(stored(labelled, 'rule-labelled')), 'rule-cutoffs')
    out = F.coalesce(F.expr('exists(zip_with(marks, cuts, (m, c) -> m > c), x -> x)'), F.lit(False))
    return (stats.join(chosen, F.col('lang').eqNullSafe(F.col('stratum')), 'left')
            .select('doc_id', 'n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words', 'base_failed',
                    (~F.col('base_failed') & ~out).alias('kept'), 'marks', 'step', 'cuts'))


@query('op7_risk_controlled_rules')
def op7_risk_controlled_rules(spark, sf_dir):
    return judge(documents(spark, sf_dir), labels(spark, sf_dir))
