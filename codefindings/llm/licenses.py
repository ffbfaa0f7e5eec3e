"""License scan by canonical digests.

A text is brought to one spelling (case, punctuation, copyright lines, equivalent spellings) and its
SHA-256 is joined with the digests of known licences. The same is done with every line on its own,
so one-line notices inside a longer document are found as well. Only digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codefindings.functions.text import rows_of
from codefindings.llm.common import documents, whole_text
from codefindings.llm.license_texts import EQUAL, FRAMES, NAMES, TEXTS, whole_texts
from codefindings.llm.registry import query

COPYRIGHT = r'(?m)^[^a-z0-9\n©]*(portions )?(copyright [^a-z]*[0-9(©]|copyright (by|holder:|owner:)|\(c\)|©|all rights reserved)[^\n]*$'
OTHER = r'[^a-z0-9\x{80}-\x{10FFFF}\n]+'
SQL_OTHER = OTHER
BROADCAST_ROWS = 100_000


def canonical_lines(text: Column) -> Column:
    """The text in one spelling, its lines kept: words separated by single blanks, lines by newlines."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT, '')
    text = F.regexp_replace(text, OTHER, ' ')
    for old, new in EQUAL:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r' ?\n[ \n]*', '\n')


def known_texts() -> list[tuple[str, str]]:
    """(license, text): whole licences in their usual forms, and the notices made of ``FRAMES`` and ``NAMES``."""
    notices = [(spdx, frame.format(name)) for spdx, names in NAMES.items() for name in names for frame in FRAMES]
    return whole_texts() + notices


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license), one row per digest, from (license, text) pairs; the texts are read once, here."""
    table = spark.createDataFrame(known_texts() if texts is None else texts, 'license string, text string')
    rows = (table.select('license', F.sha2(_joined(canonical_lines(F.col('text'))), 256).alias('digest'))
            .groupBy('digest').agg(F.min('license').alias('license')).collect())
    return spark.createDataFrame(sorted(map(tuple, rows)), 'digest string, license string')


def _joined(lines: Column) -> Column:
    return F.trim(F.replace(lines, F.lit('\n'), F.lit(' ')))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notices) for every row of ``docs``.

    ``digest`` is that of the whole canonical text, ``license`` its licence or NULL, ``notices`` the
    sorted licences, joined by commas, whose text is a line of the document ('' if none). ``docs``
    needs doc_id and text; other columns are left out. NULL and empty texts share the digest of ''
    and match nothing. Repeated rows and rows with NULL id are answered row by row: lines are looked
    up from the distinct digests of a row, and the answer goes back by the digest of its text, so
    equal texts are looked up once however many copies there are. ``known`` is broadcast if it has at
    most ``BROADCAST_ROWS`` rows, else joined by a shuffle.
    """
    texts = (docs.select('doc_id', canonical_lines(whole_text()).alias('_lines'))
             .select('doc_id', F.sha2(_joined(F.col('_lines')), 256).alias('digest'),
                     F.array_distinct(F.transform(F.split('_lines', '\n'), lambda x: F.sha2(F.trim(x), 256))).alias('_each')))
    known = known.select(F.col('digest').alias('_known'), 'license')
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    lines = (rows_of(texts, ['digest'], F.col('_each'), '_line')
             .join(known, F.col('_line') == F.col('_known')).select('digest', 'license').distinct()
             .groupBy('digest').agg(F.concat_ws(',', F.sort_array(F.collect_set('license'))).alias('notices')))
    return (texts.select('doc_id', 'digest')
            .join(known, F.col('digest') == F.col('_known'), 'left').drop('_known')
            .join(lines, 'digest', 'left')
            .select('doc_id', 'digest', 'license', F.coalesce('notices', F.lit('')).alias('notices')))


def _sql_canonical(text: str) -> str:
    text = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', '', 'g'), '{SQL_OTHER}', ' ', 'g')"
    for old, new in EQUAL:
        text = f"replace({text}, '{old}', '{new}')"
    return rf"regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH k0(license, text) AS (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in known_texts())}),
k AS (SELECT sha256(trim(replace({_sql_canonical('text')}, chr(10), ' '))) AS digest, min(license) AS license
      FROM k0 GROUP BY 1),
t AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS lines FROM documents),
d AS (SELECT doc_id, sha256(trim(replace(lines, chr(10), ' '))) AS digest, lines FROM t),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
      FROM (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS line FROM d) x
      JOIN k ON x.line = k.digest GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query('op2_license_scan', SQL)
def op2_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir), known_digests(spark))
