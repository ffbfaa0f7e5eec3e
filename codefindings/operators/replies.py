"""Model replies: extracting, parsing and sorting out the unusable ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codefindings.dims import limits
from codefindings.functions.naming import basename
from codefindings.functions.text import bind, normalize_type, rows_of

FINDING = ('struct<line_number:bigint,vulnerability_type:string,severity:string,description:string,'
           'code_snippet:string,fix_suggestion:string,confidence:double>')
SUMMARY = ('struct<total_vulnerabilities:bigint,critical_count:bigint,high_count:bigint,'
           'medium_count:bigint,low_count:bigint,info_count:bigint>')
METADATA = ('struct<filename:string,language:string,analyzed_at:double,code_length:bigint,'
            'model_used:string,tokens_used:bigint,gemini_tokens_used:bigint>')
REPLY = f'struct<vulnerabilities:array<{FINDING}>,summary:{SUMMARY},metadata:{METADATA}>'
COUNTS = ['critical_count', 'high_count', 'medium_count', 'low_count', 'info_count']

# Error kinds and our texts for them.
MESSAGES = {'no_reply': 'The model gave no reply', 'no_json': 'The reply holds no JSON object',
            'bad_json': 'The JSON in the reply does not parse'}


def json_text(reply: Column) -> Column:
    """From the first opening to the last closing brace, '' without them."""
    return F.regexp_extract(reply, r'(?s)\{.*\}', 0)


def parse(replies: DataFrame) -> DataFrame:
    """Add ``parsed`` (struct or NULL) and ``error`` (kind or NULL).

    The object is parsed as the only element of an array: text after the object then is an error
    instead of being ignored. Both columns come out of one row-producing step, so filters on
    ``error`` do not repeat the parsing below it.
    """
    reply = F.col('reply')

    def judged(json, found):
        error = (F.when(reply.isNull(), 'no_reply').when(json == '', 'no_json')
                 .when(F.coalesce(F.size(found), F.lit(0)) != 1, 'bad_json'))
        return F.struct(error.alias('error'), F.when(error.isNull(), F.get(found, F.lit(0))).alias('parsed'))

    def parsed(json):
        as_list = F.from_json(F.concat(F.lit('['), json, F.lit(']')), f'array<{REPLY}>',
                              {'allowSingleQuotes': 'false'})
        return bind(as_list, lambda found: judged(json, found))

    keep = replies.columns
    return rows_of(replies, keep, F.array(bind(json_text(reply), parsed)), 'r').select(*keep, 'r.*')


def good(parsed: DataFrame) -> DataFrame:
    """Usable replies: findings array, summary (derived when missing) and token count."""
    found = F.coalesce('parsed.vulnerabilities', F.expr(f'cast(array() as array<{FINDING}>)'))
    total = F.when(F.col('parsed.summary').isNull(), F.size('vulnerabilities').cast('bigint')) \
        .otherwise(F.coalesce('parsed.summary.total_vulnerabilities', F.lit(0)))
    return (parsed.filter('error IS NULL').withColumn('vulnerabilities', found)
            .withColumn('total_vulnerabilities', total)
            .withColumns({c: F.coalesce(f'parsed.summary.{c}', F.lit(0)) for c in COUNTS})
            .withColumn('tokens_used', F.coalesce(
                'parsed.metadata.tokens_used', 'parsed.metadata.gemini_tokens_used', F.lit(0)))
            .drop('parsed', 'error', 'reply'))


def errors(parsed: DataFrame) -> DataFrame:
    """Dead-letter rows: error kind, message, the whole reply and its start as an excerpt."""
    message = F.when(F.lit(False), F.lit(None).cast('string'))
    for kind, text in MESSAGES.items():
        message = message.when(F.col('error') == kind, text)
    return (parsed.filter('error IS NOT NULL').withColumn('message', message)
            .withColumn('raw_response', F.substring(F.coalesce('reply', F.lit('')), 1, limits.RAW_EXCERPT))
            .withColumn('total_vulnerabilities', F.lit(0).cast('bigint')).drop('parsed'))


def findings(usable: DataFrame, keep) -> DataFrame:
    """One row per finding of the usable replies, in reply order."""
    return rows_of(usable, keep, F.col('vulnerabilities'), 'v', 'ord').select(
        *keep, 'ord', 'v.*', F.lit(None).cast('string').alias('detection_method'))


def token_totals(usable: DataFrame, *keys: str) -> DataFrame:
    return usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias('replies'), F.sum('tokens_used').cast('bigint').alias('tokens'),
        F.sum('code_length').cast('bigint').alias('code_length'))


STORED = ('map<string,struct<metadata:struct<filename:string>,file:string,vulnerabilities:'
          'array<struct<vulnerability_type:string,type:string,line_number:bigint,line:bigint>>>>')


def stored_predictions(documents: DataFrame, keep=()) -> DataFrame:
    """Predictions from stored result documents (column ``json``): name -> analysis.

    File: metadata, else 'file', else the name; line: the first non-zero of two fields, else -1.
    """
    def given(*columns):
        return F.coalesce(*[F.nullif(F.col(c), F.lit('')) for c in columns])
    tests = rows_of(documents, keep, F.map_entries(F.from_json('json', STORED)), 't')
    named = tests.select(*keep, basename(given('t.value.metadata.filename', 't.value.file', 't.key'))
                         .alias('file'), F.col('t.value.vulnerabilities').alias('found'))
    rows = rows_of(named, [*keep, 'file'], F.col('found'), 'v', 'ord')
    line = F.coalesce(F.nullif('v.line_number', F.lit(0)), F.nullif('v.line', F.lit(0)), F.lit(-1))
    kind = F.coalesce(F.nullif('v.vulnerability_type', F.lit('')), 'v.type', F.lit(''))
    return rows.select(*keep, 'file', normalize_type(kind).alias('type'),
                       line.cast('bigint').alias('line'), 'ord')
