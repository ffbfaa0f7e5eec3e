"""Expressions over file names, paths and repository URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codefindings.dims import languages as dim, names


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed dictionary, NULL when absent. The map folds to one literal."""
    text = '\n'.join(f'{k}\t{v}' for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit('\n'), F.lit('\t')), key)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; leading dots belong to the stem; '' without one."""
    return F.regexp_extract(F.lower(name), r'(?s)^\.*[^.].*(\.[^.]*)$', 1)


def last_dot_extension(name: Column) -> Column:
    """Everything after the last dot, with a dot; '' for a name without a dot."""
    return F.when(name.contains('.'), F.concat(
        F.lit('.'), F.substring_index(F.lower(name), '.', -1))).otherwise('')


def ui_extension(name: Column) -> Column:
    """As :func:`last_dot_extension`, but a dot-less name is its own extension."""
    return F.concat(F.lit('.'), F.substring_index(F.lower(name), '.', -1))


def basename(path: Column) -> Column:
    return F.substring_index(path, '/', -1)


def directories(path: Column) -> Column:
    parts = F.split(path, '/', -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def contains_any(column: Column, values: list[str]) -> Column:
    """Whether one of the literals occurs; a single pattern keeps the expression small."""
    return column.rlike('|'.join(map(re.escape, values)))


def ends_with_any(column: Column, values: list[str]) -> Column:
    return column.rlike('(?:' + '|'.join(map(re.escape, values)) + r')\z')


def language_full(name: Column) -> Column:
    low = F.lower(name)
    by_words = F.when(F.lit(False), F.lit(None).cast('string'))
    for words, language in dim.NAME_WORDS:
        by_words = by_words.when(contains_any(low, list(words)), language)
    return F.when(F.coalesce(name, F.lit('')) == '', 'text').otherwise(F.coalesce(
        lookup(dim.FULL_EXTENSIONS, extension(name)), lookup(dim.FULL_NAMES, low),
        F.when(extension(name) == '', by_words), F.lit('text')))


def language_repo(name: Column) -> Column:
    return F.coalesce(lookup(dim.REPO_EXTENSIONS, extension(name)), F.lit('unknown'))


def language_content(name: Column, content: Column, sample: int | None = None) -> Column:
    """Language by extension, name, else by the first marker in the content (or in its first ``sample`` characters)."""
    head = F.lower(content if sample is None else F.substring(content, 1, sample))
    markers = F.when(F.lit(False), F.lit(None).cast('string'))
    for marker, language in dim.CONTENT_MARKERS:
        markers = markers.when(head.contains(marker), language)
    return F.coalesce(
        lookup(dim.CONTENT_EXTENSIONS, last_dot_extension(name)),
        F.when(F.lower(name).isin(dim.CONTENT_NAMES), F.lower(name)), markers, F.lit('unknown'))


def display_dim(spark: SparkSession) -> DataFrame:
    """(key, display_name, colour, category): keys are extensions and whole names."""
    rows = [(k, *v) for k, v in {**dim.DISPLAY_EXTENSIONS, **dim.DISPLAY_NAMES}.items()]
    return spark.createDataFrame(rows, 'key string, display_name string, colour string, category string')


def language_dim(spark: SparkSession) -> DataFrame:
    """(ext, language) rows of the full table, for joins and for the caller to extend."""
    return spark.createDataFrame(list(dim.FULL_EXTENSIONS.items()), 'ext string, language string')


def with_display(files: DataFrame) -> DataFrame:
    """Add display name, colour and category by joining the fixed display table (39 rows)."""
    low = F.lower('filename')
    key = F.when(low.isin(list(dim.DISPLAY_NAMES)), low).otherwise(ui_extension(F.col('filename')))
    name, colour, category = (F.lit(v) for v in dim.DISPLAY_DEFAULT)
    return (files.withColumn('key', key)
            .join(F.broadcast(display_dim(files.sparkSession)), 'key', 'left').drop('key')
            .withColumn('display_name', F.coalesce('display_name', name))
            .withColumn('colour', F.coalesce('colour', colour))
            .withColumn('category', F.coalesce('category', category)))


def repo_parts(url: Column) -> dict[str, Column]:
    """owner and name of a repository URL; NULL (owner) or the last part for unknown hosts."""
    clean = F.regexp_replace(url, r'\.git\z', '')
    parts = F.split(clean, '/', -1)
    known = contains_any(clean, names.REPO_HOSTS)
    public = F.split(F.replace(F.replace(url, F.lit('https://github.com/'), F.lit('')),
                               F.lit('.git'), F.lit('')), '/', -1)
    is_public = url.contains('github.com') & (F.size(public) >= 2)
    return {
        'owner': F.when(known, F.try_element_at(parts, F.lit(-2))),
        'name': F.try_element_at(parts, F.lit(-1)),
        'supported': known,
        # Without a client token the URL is taken apart more loosely: '.git' goes anywhere.
        'public_owner': F.when(is_public, F.try_element_at(public, F.lit(1))),
        'public_name': F.when(is_public, F.try_element_at(public, F.lit(2))),
    }


def commit_short(sha: Column, message: Column, date: Column) -> dict[str, Column]:
    return {
        'short_sha': F.substring(sha, 1, 8),
        'subject': F.substring_index(message, '\n', 1),
        'iso_date': F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"),
    }
