"""Row filters over file entries, findings and scans. Each takes and returns a DataFrame or column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codefindings.dims import limits, names
from codefindings.functions import text
from codefindings.functions.naming import (basename, contains_any, directories, ends_with_any,
                                           extension, ui_extension)
from codefindings.operators.ordered import running_sum

VARIANTS = ('upload', 'repository')


def in_ignored_dir(path: Column, variant: str = 'upload') -> Column:
    ignored = names.IGNORED_DIRS if variant == 'upload' else names.IGNORED_DIRS_REPO
    return F.arrays_overlap(directories(F.lower(path)), F.array(*[F.lit(d) for d in ignored]))


def is_ignored_name(name: Column, variant: str = 'upload') -> Column:
    low = F.lower(name)
    repo = variant == 'repository'
    hidden = low.startswith('.') & ~low.isin(
        names.VISIBLE_DOTFILES_REPO if repo else names.VISIBLE_DOTFILES)
    test = (hidden | ends_with_any(low, names.TEMP_SUFFIXES_REPO if repo else names.TEMP_SUFFIXES)
            | extension(name).isin(names.REPO_BINARY_EXT if repo else names.BINARY_EXT)
            | contains_any(low, names.GENERATED_PARTS))
    if repo:
        test = (test | low.contains(':zone.identifier') | low.endswith('.identifier')
                | ends_with_any(low, names.REPO_IMAGE_EXT + names.MEDIA_EXT + names.FONT_EXT)
                | contains_any(low, names.ICON_PARTS))
    return test


def sized(size: Column, limit: int | None = names.MAX_FILE) -> Column:
    """Not empty and, if there is a limit, not larger."""
    return size > 0 if limit is None else (size > 0) & (size <= limit)


def within_budget(files: DataFrame, limit: int, keys=('repo',)) -> DataFrame:
    """Keep files, in path order, while their running total size stays within ``limit``."""
    return running_sum(files, list(keys), ['path'], F.col('size'), 'running_size').filter(
        F.col('running_size') <= limit)


def is_text_bytes(content: Column, sample: int | None = None) -> Column:
    return F.coalesce(text.text_ratio(content, sample) > 0.7, F.lit(False))


def is_text_chars(content: Column, sample: int | None = None) -> Column:
    return F.coalesce(text.printable_ratio(content, sample) > 0.7, F.lit(False))


def is_binary_upload(name: Column) -> Column:
    return extension(name).isin(names.UPLOAD_BINARY_EXT)


def is_binary_ui(name: Column) -> Column:
    return ui_extension(name).isin(names.BINARY_EXT)


def has_content(content: Column) -> Column:
    return F.length(text.strip(content)) >= limits.MIN_CONTENT_CHARS


def upload_reason(name: Column, size: Column, as_archive: Column) -> Column:
    """Why an upload is refused; NULL when it is accepted."""
    single = F.when(is_binary_upload(name), 'binary').when(size > names.MAX_UPLOAD, 'too_large')
    archive = (F.when(~ends_with_any(name, names.ARCHIVE_SUFFIXES), 'not_an_archive')
               .when(size > names.MAX_ARCHIVE, 'too_large'))
    return F.when(as_archive, archive).otherwise(single)


def split_by_file_count(files: DataFrame, keys=('repo',),
                        limit: int = names.MAX_FILES_PER_TREE) -> tuple[DataFrame, DataFrame]:
    """(trees, refused trees): a tree with more than ``limit`` files is refused as a whole."""
    counts = files.groupBy(*keys).agg(F.count(F.lit(1)).alias('n_files'))
    over = F.col('n_files') > limit
    return counts.filter(~over), counts.filter(over)


def is_supported_repo(url: Column) -> Column:
    return F.coalesce(contains_any(url, names.REPO_HOSTS), F.lit(False))


def is_manifest(path: Column) -> Column:
    pruned = F.arrays_overlap(directories(path),
                              F.array(*[F.lit(d) for d in names.MANIFEST_IGNORED_DIRS]))
    return basename(path).isin(names.MANIFESTS) & ~pruned


def confident(found: DataFrame, floor: float = 0.7) -> DataFrame:
    return found.filter(F.col('confidence') > floor)


def lookup_scans(requested: DataFrame, scans: DataFrame) -> DataFrame:
    """Answer each requested id from the latest scan states: missing, processing, failed, results."""
    status = F.col('status')
    answer = (F.when(status.isNull(), 'missing').when(status == 'processing', 'processing')
              .when(status == 'failed', 'failed').otherwise('results'))
    return requested.join(scans, 'analysis_id', 'left').withColumn('answer', answer)
