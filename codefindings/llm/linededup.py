"""Lines that many documents share, found by sorting line hashes; DataFrame expressions only.

1. Every line with a key (blanks at both ends cut, A-Z as a-z) becomes a narrow row: hash of the key,
   the document, the line's number. The rows are range-partitioned by (hash, document) and sorted by
   (hash, document, position), so a line that a third of all documents hold spreads over many slices.
2. Each slice is streamed once: a row is a first occurrence if it is the first of its hash in its
   document. First occurrences are counted per hash (summed per slice, before they meet), and the
   first of them all is the smallest (document, position).
3. Lines to go become bits of their document, 64 lines a word. Words that keep all their lines are not
   stored. The result is this bitmap per document, never text; ``kept_lines`` applies it to a text.

A document is a row: repeated rows count once each. It is named by its id and a 64-bit hash of its
text, so NULL and repeated ids are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codefindings.functions.text import rows_of
from codefindings.llm.common import doc_id, documents, join_by_key, stored, whole_text
from codefindings.llm.registry import query

BLANKS = ' \t\n\x0b\x0c\r'
UPPER, LOWER = 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
WORD_BITS = 64
ALL_KEPT = -1

SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.r, k.i, k.line, gone.key IS NOT NULL AS dropped FROM k LEFT JOIN gone ON k.key = gone.key)
SELECT d.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256
FROM d JOIN (SELECT r, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS kept
             FROM m GROUP BY r) x ON d.r = x.r
"""


def text_lines(text: Column) -> Column:
    """The \\n-split lines of a text; an empty text is one empty line."""
    return F.split(text, '\n')


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z as a-z; other letters keep their case.

    ``lower`` does the same for a line of ASCII characters, and much faster than ``translate``.
    """
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of every row; the first two name the document."""
    return docs.select(doc_id(), F.xxhash64(whole_text()).alias('text_hash'), whole_text().alias('text'))


def occurrences(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """(hash, doc_id, text_hash, at, first): all lines with a key of ``min_length`` code points, sorted.

    ``at`` is the line's place from 0; ``first`` marks its first occurrence in the document. Equal rows
    tie, so each of several repeated documents has its own first occurrence.
    """
    spread = rows_of(named(docs), ['doc_id', 'text_hash'], text_lines(F.col('text')), 'line', 'at').withColumn(
        'key', line_key(F.col('line')))
    keyed = spread.filter(F.char_length('key') >= max(1, min_length)).select(
        F.xxhash64('key').alias('hash'), 'doc_id', 'text_hash', 'at')
    own = ['hash', 'doc_id', 'text_hash']
    dealt = stored(keyed, 'lines').repartitionByRange(*own)
    return dealt.withColumn('first', F.rank().over(Window.partitionBy(*own).orderBy('at')) == 1)


def shared_lines(sorted_lines: DataFrame, min_documents: int) -> DataFrame:
    """(hash, documents, places, lead) of the hashes with first occurrences in ``min_documents`` documents.

    ``places`` counts all their lines; ``lead`` (doc_id, text_hash, at) is the first of them in the order
    of the sort, NULL ids first.
    """
    lead = F.min(F.struct('doc_id', 'text_hash', 'at'))
    return (sorted_lines.groupBy('hash')
            .agg(F.count_if('first').alias('documents'), F.count(F.lit(1)).alias('places'), lead.alias('lead'))
            .filter(F.col('documents') >= min_documents))


def keep_bitmaps(docs: DataFrame, min_documents: int = 10, min_length: int = 1, keep_lead: bool = False) -> DataFrame:
    """(doc_id, text_hash, keep): the keep bitmaps of the documents that lose lines.

    A key found in at least ``min_documents`` documents loses all its lines, or with ``keep_lead`` all
    but the first one in the order of (id, text hash, position). ``keep`` lists (word, bits) in order:
    bit ``at % 64`` of word ``at / 64`` is set if the line stays; words that keep all lines, and documents
    that keep all lines, are left out. Repeated rows share a bitmap. NULL texts count as empty, empty and
    blank lines have no key and stay; an empty table gives no rows. Other columns are not read.
    """
    lines = stored(occurrences(docs, min_length), 'sorted-lines')
    gone = stored(shared_lines(lines, min_documents), 'shared-lines')
    marked = join_by_key(lines, gone.withColumnRenamed('hash', '_hash'), 'hash', '_hash', 'places')
    if keep_lead:
        marked = marked.filter(~F.struct('doc_id', 'text_hash', 'at').eqNullSafe(F.col('lead')))
    own = ['doc_id', 'text_hash']
    word = F.shiftright('at', 6).alias('word')
    bit = F.expr(f'shiftleft(1L, at % {WORD_BITS})')
    words = marked.groupBy(*own, word).agg(F.bitwise_not(F.bit_or(bit)).alias('bits'))
    return words.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct('word', 'bits'))).alias('keep'))


def words_of(keep: Column) -> Column:
    """The bitmap with the left-out words up to its last one: an array of 64-bit words."""
    before = lambda i: F.when(i > 0, F.get(keep, i - 1)['word']).otherwise(-1)
    return F.flatten(F.transform(keep, lambda x, i: F.concat(
        F.array_repeat(F.lit(ALL_KEPT).cast('bigint'), x['word'] - before(i) - 1), F.array(x['bits']))))


def kept_lines(text: Column, words: str) -> Column:
    """The lines of a text that the bitmap in column ``words`` keeps; words beyond its end keep all."""
    def stays(line, i):
        bits = F.coalesce(F.get(F.col(words), F.shiftright(i, 6)), F.lit(ALL_KEPT).cast('bigint'))
        return F.getbit(bits, i % WORD_BITS) == 1
    return F.filter(text_lines(text), stays)


def without_shared_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every row of ``docs`` with what its bitmap keeps of the text.

    Texts meet their bitmaps in a sort-merge join at any size: bitmaps grow with the documents.
    """
    b = bitmaps.select(F.col('doc_id').alias('_id'), F.col('text_hash').alias('_text'), words_of(F.col('keep')).alias('words'))
    whole = named(docs).join(b.hint('merge'), F.col('doc_id').eqNullSafe(F.col('_id')) & (F.col('text_hash') == F.col('_text')), 'left')
    count = F.size(text_lines(F.col('text')))
    kept = whole.select('doc_id', 'text', count.cast('bigint').alias('n_lines'),
                        F.when(F.col('words').isNotNull(), kept_lines(F.col('text'), 'words')).alias('kept'))
    dropped = F.when(F.col('kept').isNull(), 0).otherwise(F.col('n_lines') - F.size('kept'))
    return kept.select('doc_id', 'n_lines', dropped.cast('bigint').alias('n_dropped'),
                       F.when(F.col('kept').isNull(), F.col('text')).otherwise(F.array_join('kept', '\n')).alias('text'))


@query('op11_line_dedup', SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = without_shared_lines(docs, stored(keep_bitmaps(docs), 'keep-bitmaps'))
    return found.select('doc_id', 'n_lines', 'n_dropped', F.sha2('text', 256).alias('kept_sha256'))
