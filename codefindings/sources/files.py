"""File trees: listing, discovery and decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from codefindings.functions import naming
from codefindings.operators import filters
from codefindings.operators.snapshots import only_changed
from codefindings.sources import trees
from codefindings.sources.scratch import checkpointed

#: Rows handed to Python at a time when contents are decoded.
DECODE_ROWS = 500
_BATCH = 'spark.sql.execution.arrow.maxRecordsPerBatch'


def marked(files: DataFrame, keys=('repo',), variant: str = 'repository', max_file: int | None = None,
           max_tree: int | None = None) -> DataFrame:
    """Add ``status``: why a listed file is not looked into, NULL for all others.

    Reasons: missing_root, linked_dir, unreadable_dir, ignored_dir, ignored_name, empty, too_large (over ``max_file`` bytes),
    over_budget (its tree, in path order, has reached ``max_tree`` bytes). Without the two limits every
    file of a wanted name and place is looked into. Contents are not touched.
    """
    size = F.col('size')
    status = F.when(F.lit(False), F.lit(None).cast('string'))
    if 'problem' in files.columns:
        status = status.when(F.col('problem').isNotNull(), F.col('problem'))
    status = (status.when(filters.in_ignored_dir(F.col('path'), variant), 'ignored_dir')
              .when(filters.is_ignored_name(F.col('filename'), variant), 'ignored_name')
              .when(~F.coalesce(filters.sized(size, None), F.lit(False)), 'empty'))
    if max_file is not None:
        status = status.when(size > max_file, 'too_large')
    named = files.withColumn('status', status).drop('problem')
    return named if max_tree is None else _with_budget(named, list(keys), max_tree)


def report(files: DataFrame, keys=('repo',), variant: str = 'repository', max_file: int | None = None,
           max_tree: int | None = None) -> DataFrame:
    """Every file with language, extension and ``status``: scanned, not_text, unreadable or a reason of :func:`marked`.

    ``files`` holds path, filename, size and content. The content is tested last, and neither
    shuffled nor joined on unless a tree budget is given.
    """
    return _tested(marked(files, keys, variant, max_file, max_tree), variant)


def discover(files: DataFrame, keys=('repo',), variant: str = 'repository', max_file: int | None = None,
             max_tree: int | None = None) -> DataFrame:
    """The files worth scanning: those :func:`report` calls scanned."""
    return report(files, keys, variant, max_file, max_tree).filter("status = 'scanned'").drop('status')


def report_trees(roots: DataFrame, variant: str = 'repository', changed: DataFrame | None = None,
                 max_file: int | None = None, max_tree: int | None = None) -> DataFrame:
    """:func:`report` of all files under the given (repo, root) folders; only files worth it are opened.

    Folders are listed once, into the checkpoint folder. With a ``changed`` (repo, path) table the
    listing is reduced to it before any file is opened.
    """
    listed = checkpointed(marked(trees.list_trees(roots, variant), ('repo', 'root'), variant, max_file, max_tree))
    if changed is not None:
        listed = only_changed(listed, changed)
    opened = _tested(trees.with_contents(listed.filter('status IS NULL')), variant)
    return opened.unionByName(listed.filter('status IS NOT NULL'), allowMissingColumns=True)


def discover_trees(roots: DataFrame, variant: str = 'repository', changed: DataFrame | None = None,
                   max_file: int | None = None, max_tree: int | None = None) -> DataFrame:
    """The files under the given (repo, root) folders that are worth scanning."""
    return report_trees(roots, variant, changed, max_file, max_tree).filter("status = 'scanned'").drop('status')


def status_counts(files: DataFrame, keys=('repo',)) -> DataFrame:
    """Number and bytes of files per ``keys`` and status."""
    return files.groupBy(*keys, 'status').agg(F.count(F.lit(1)).alias('n_files'), F.sum('size').alias('bytes'))


def _tested(files: DataFrame, variant: str) -> DataFrame:
    is_text = filters.is_text_bytes if variant == 'repository' else filters.is_text_chars
    language = naming.language_repo if variant == 'repository' else naming.language_full
    content = F.col('content')
    if variant != 'repository' and dict(files.dtypes)['content'] == 'binary':
        files = decode(files).withColumnRenamed('text', 'content')
    tested = F.when(content.isNull(), 'unreadable').when(is_text(content), 'scanned').otherwise('not_text')
    return (files.withColumn('status', F.when(F.col('status').isNotNull(), F.col('status')).otherwise(tested))
            .withColumn('language', language(F.col('filename')))
            .withColumn('extension', naming.extension(F.col('filename'))))


def _with_budget(files: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Mark what lies behind the path at which a tree's budget ends; one narrow row per tree is joined."""
    sizes = files.filter('status IS NULL').select(*keys, 'path', 'size')
    ends = filters.within_budget(sizes, limit, keys).groupBy(*keys).agg(F.max('path').alias('_last'))
    over = F.col('_last').isNull() | (F.col('path') > F.col('_last'))
    return (files.join(ends, keys, 'left')
            .withColumn('status', F.when(F.col('status').isNull() & over, 'over_budget').otherwise(F.col('status')))
            .drop('_last'))


def decode(df: DataFrame) -> DataFrame:
    """bytes ``content`` -> ``text`` and ``encoding``: UTF-8, else UTF-16, else Latin-1.

    Valid UTF-8 is decoded in the JVM; only the other contents are handed to Python, in the same
    pass. There UTF-16 follows the byte order mark and, without one, little-endian order. From now on the
    session hands at most ``DECODE_ROWS`` rows to Python at a time: whole files may be long.
    """
    conf = df.sparkSession.conf
    conf.set(_BATCH, str(min(DECODE_ROWS, int(conf.get(_BATCH)) if int(conf.get(_BATCH)) > 0 else DECODE_ROWS)))
    tried = df.withColumn('_utf8', F.try_validate_utf8(F.col('content').cast('string')))
    rest = tried.withColumn('_other', _fallback(F.when(F.col('_utf8').isNull(), F.col('content'))))
    return (rest.withColumn('text', F.coalesce('_utf8', '_other.text'))
            .withColumn('encoding', F.when(F.col('content').isNotNull(), F.coalesce(
                F.col('_other.encoding'), F.lit('utf-8'))))
            .drop('_utf8', '_other', 'content'))


@F.pandas_udf(T.StructType().add('text', 'string').add('encoding', 'string'))
def _fallback(content: pd.Series) -> pd.DataFrame:
    def one(raw):
        if raw is None:
            return None, None
        try:
            return bytes(raw).decode('utf-16'), 'utf-16'
        except UnicodeDecodeError:
            return bytes(raw).decode('latin-1'), 'latin-1'
    return pd.DataFrame([one(raw) for raw in content], columns=['text', 'encoding'], dtype=object)
