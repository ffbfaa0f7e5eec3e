"""Queries: sources, filters and scalar projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefindings import bindings as b
from codefindings.bindings import quoted, sql_list, with_sql
from codefindings.catalog.registry import query
from codefindings.dims import languages, limits, names, severity as sev
from codefindings.functions import naming, risk, text
from codefindings.operators import filters, prompts
from codefindings.sources import files as file_sources

WS = r'[\t-\r\x1c-\x20]'
STRIP_SQL = "regexp_replace({0}, '^" + WS + '+|' + WS + "+$', '', 'g')"


def _overlap(values):
    return f"list_has_any(split(lower(path), '/')[1:-2], {sql_list(values)})"


def _ends(values, col='low'):
    return '(' + ' OR '.join(f'ends_with({col}, {quoted(v)})' for v in values) + ')'


def _has(values, col='low'):
    return '(' + ' OR '.join(f'contains({col}, {quoted(v)})' for v in values) + ')'


def _in(values):
    return '(' + ', '.join(quoted(v) for v in values) + ')'


EXT_SQL = r"regexp_extract(lower({0}), '(?s)^\.*[^.].*(\.[^.]*)$', 1)"


def _map(table, key):
    return 'CASE ' + key + ' ' + ' '.join(
        f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in table.items()) + ' END'


# ---- sources -------------------------------------------------------------------------------
_NAMES_REPO = f"""NOT (
   (starts_with(low, '.') AND low NOT IN {_in(names.VISIBLE_DOTFILES_REPO)})
   OR {_ends(names.TEMP_SUFFIXES_REPO + names.REPO_IMAGE_EXT + names.MEDIA_EXT + names.FONT_EXT)}
   OR ext IN {_in(names.REPO_BINARY_EXT)} OR {_has(names.GENERATED_PARTS + names.ICON_PARTS)}
   OR contains(low, ':zone.identifier') OR ends_with(low, '.identifier'))"""
_NAMES_UPLOAD = f"""NOT ((starts_with(low, '.') AND low NOT IN {_in(names.VISIBLE_DOTFILES)})
   OR {_ends(names.TEMP_SUFFIXES)} OR ext IN {_in(names.BINARY_EXT)} OR {_has(names.GENERATED_PARTS)})"""
_NAMED = f'SELECT *, lower(filename) AS low, {EXT_SQL.format("filename")} AS ext FROM files'
_PRINTABLE_PAIR = '(0[9AD]|[2-6][0-9A-F]|7[0-9A-E])|(..)'
# Share of printable ASCII; bytes are looked at as hex pairs.
RATIOS_SQL = f"""ratios AS (
  SELECT path, CAST(length(hx) - length(regexp_replace(hx, '{_PRINTABLE_PAIR}', '\\2', 'g')) AS DOUBLE)
    / nullif(length(hx), 0) AS ratio
  FROM (SELECT path, hex(encode(content)) AS hx FROM files))"""
_REPO_LANGUAGE = f"coalesce({_map(languages.REPO_EXTENSIONS, 'ext')}, 'unknown')"


@query('src_files', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', RATIOS_SQL, body=f"""
SELECT repo, path, filename, size, {_REPO_LANGUAGE} AS language, ext AS extension
FROM named JOIN ratios USING (path)
WHERE NOT {_overlap(names.IGNORED_DIRS_REPO)} AND {_NAMES_REPO}
  AND size > 0 AND ratio > 0.7"""))
def src_files(spark, sf):
    return file_sources.discover(b.files(spark, sf), keys=('repo',)).select(
        'repo', 'path', 'filename', 'size', 'language', 'extension')


# Latin-1 rows have an odd number of bytes, so they are no UTF-16; without an accent they are UTF-8.
_ODD = "text || CASE WHEN length(text) % 2 = 0 THEN 'x' ELSE '' END"


@query('src_decode', sql=f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'utf-16' WHEN doc_id % 3 = 1 AND strlen(t) > length(t) THEN 'latin-1' ELSE 'utf-8' END AS encoding,
  CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN {_ODD} ELSE text END AS t FROM documents)""")
def src_decode(spark, sf):
    d = b.table(spark, sf, 'documents')
    k = F.col('doc_id') % 3
    odd = F.concat('text', F.when(F.length('text') % 2 == 0, 'x').otherwise(''))
    raw = (F.when(k == 0, F.encode('text', 'UTF-8')).when(k == 1, F.encode(odd, 'ISO-8859-1'))
           .otherwise(F.concat(F.unhex(F.lit('FFFE')), F.encode('text', 'UTF-16LE'))))
    decoded = file_sources.decode(d.select('doc_id', raw.alias('content')))
    return decoded.select('doc_id', 'encoding', F.length('text').cast('bigint').alias('n_chars'),
                          F.md5('text').alias('text_md5'))


@query('src_report', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', RATIOS_SQL, body=f"""
SELECT repo, status, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT repo, size, CASE WHEN {_overlap(names.IGNORED_DIRS_REPO)} THEN 'ignored_dir' WHEN NOT {_NAMES_REPO} THEN 'ignored_name'
    WHEN size <= 0 THEN 'empty' WHEN size > 5000 THEN 'too_large' WHEN ratio > 0.7 THEN 'scanned' ELSE 'not_text' END AS status
  FROM named JOIN ratios USING (path)) GROUP BY repo, status"""))
def src_report(spark, sf):
    return file_sources.status_counts(file_sources.report(b.files(spark, sf), max_file=5000))


# ---- filters -------------------------------------------------------------------------------
@query('flt_dirs', sql=with_sql(b.FILES_SQL, body=f"""
SELECT path, NOT {_overlap(names.IGNORED_DIRS)} AS keep_upload,
  NOT {_overlap(names.IGNORED_DIRS_REPO)} AS keep_repository FROM files"""))
def flt_dirs(spark, sf):
    return b.files(spark, sf).select(
        'path', (~filters.in_ignored_dir(F.col('path'))).alias('keep_upload'),
        (~filters.in_ignored_dir(F.col('path'), 'repository')).alias('keep_repository'))


@query('flt_names', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', body=f"""
SELECT path, {_NAMES_UPLOAD} AS keep_upload, {_NAMES_REPO} AS keep_repository FROM named"""))
def flt_names(spark, sf):
    name = F.col('filename')
    return b.files(spark, sf).select(
        'path', (~filters.is_ignored_name(name)).alias('keep_upload'),
        (~filters.is_ignored_name(name, 'repository')).alias('keep_repository'))


_SCALED = "SELECT * REPLACE (size * (1 + doc_id % 5) * 400 - 400 * (doc_id % 9) * size AS size) FROM files"


@query('flt_size', sql=with_sql(b.FILES_SQL, f'scaled AS ({_SCALED})', body=f"""
SELECT path, size FROM scaled WHERE size > 0 AND size <= {names.MAX_FILE}"""))
def flt_size(spark, sf):
    size = F.expr('size * (1 + doc_id % 5) * 400 - 400 * (doc_id % 9) * size')
    return (b.files(spark, sf).withColumn('size', size).filter(filters.sized(F.col('size')))
            .select('path', 'size'))


@query('flt_budget', sql=with_sql(b.FILES_SQL, body="""
SELECT repo, path, running_size FROM (
  SELECT repo, path, CAST(sum(size * 5000) OVER (PARTITION BY repo ORDER BY path
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_size FROM files WHERE size > 0)
WHERE running_size <= """ + str(names.MAX_TREE)))
def flt_budget(spark, sf):
    sizes = b.files(spark, sf).filter('size > 0').select(
        'repo', 'path', (F.col('size') * 5000).alias('size'))
    return filters.within_budget(sizes, names.MAX_TREE).select('repo', 'path', 'running_size')


@query('flt_text_ratio', sql=with_sql(b.FILES_SQL, RATIOS_SQL, body="""
SELECT path, ratio, coalesce(ratio > 0.7, false) AS is_text FROM ratios"""))
def flt_text_ratio(spark, sf):
    return b.files(spark, sf).select(
        'path', text.text_ratio(F.col('content')).alias('ratio'),
        filters.is_text_bytes(F.col('content')).alias('is_text'))


@query('flt_binary_ext', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', body=f"""
SELECT path, ext NOT IN {_in(names.UPLOAD_BINARY_EXT)} AS keep_upload,
  '.' || split(low, '.')[-1] NOT IN {_in(names.BINARY_EXT)} AS keep_ui FROM named"""))
def flt_binary_ext(spark, sf):
    name = F.col('filename')
    return b.files(spark, sf).select('path', (~filters.is_binary_upload(name)).alias('keep_upload'),
                                     (~filters.is_binary_ui(name)).alias('keep_ui'))


_SHORT = """SELECT path, content FROM files UNION ALL SELECT path || '.short',
  CASE doc_id % 2 WHEN 0 THEN left(content, 12) ELSE '  ' || chr(9) || left(content, 8) || chr(10) END FROM files"""


@query('flt_min_content', sql=with_sql(b.FILES_SQL, f'both_kinds AS ({_SHORT})', body=f"""
SELECT path, CAST(length(content) AS BIGINT) AS n FROM both_kinds
WHERE length({STRIP_SQL.format('content')}) >= {limits.MIN_CONTENT_CHARS}"""))
def flt_min_content(spark, sf):
    files = b.files(spark, sf)
    short = (F.when(F.col('doc_id') % 2 == 0, F.substring('content', 1, 12))
             .otherwise(F.concat(F.lit('  \t'), F.substring('content', 1, 8), F.lit('\n'))))
    both = files.select('path', 'content').unionByName(
        files.select(F.concat('path', F.lit('.short')).alias('path'), short.alias('content')))
    return both.filter(filters.has_content(F.col('content'))).select(
        'path', F.length('content').cast('bigint').alias('n'))


TREE_FILES = 30


@query('flt_upload_limits', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', body=f"""
SELECT path, n_files, CASE WHEN doc_id % 2 = 0 THEN
    CASE WHEN NOT {_ends(names.ARCHIVE_SUFFIXES, 'filename')} THEN 'not_an_archive'
         WHEN size * 100000 > {names.MAX_ARCHIVE} THEN 'too_large' END
  ELSE CASE WHEN ext IN {_in(names.UPLOAD_BINARY_EXT)} THEN 'binary'
         WHEN size * 10000 > {names.MAX_UPLOAD} THEN 'too_large' END END AS reason,
  n_files > {TREE_FILES} AS tree_refused
FROM named JOIN (SELECT repo, count(*) AS n_files FROM files GROUP BY repo) USING (repo)"""))
def flt_upload_limits(spark, sf):
    files = b.files(spark, sf)
    archive = F.col('doc_id') % 2 == 0
    size = F.col('size') * F.when(archive, 100000).otherwise(10000)
    accepted, refused = filters.split_by_file_count(files, limit=TREE_FILES)
    trees = (accepted.withColumn('tree_refused', F.lit(False))
             .unionByName(refused.withColumn('tree_refused', F.lit(True))))
    return files.join(trees, 'repo').select(
        'path', 'n_files', filters.upload_reason(F.col('filename'), size, archive).alias('reason'),
        'tree_refused')


@query('flt_repo_host', sql=with_sql(b.REPOS_SQL, body=f"""
SELECT page_id, url FROM repos WHERE {_has(names.REPO_HOSTS, 'url')}"""))
def flt_repo_host(spark, sf):
    return b.repos(spark, sf).filter(filters.is_supported_repo(F.col('url')))


@query('flt_manifests', sql=with_sql(b.FILES_SQL, body=f"""
SELECT path, filename FROM files WHERE filename IN {_in(names.MANIFESTS)}
  AND NOT list_has_any(split(path, '/')[1:-2], {sql_list(names.MANIFEST_IGNORED_DIRS)})"""))
def flt_manifests(spark, sf):
    return b.files(spark, sf).filter(filters.is_manifest(F.col('path'))).select('path', 'filename')


@query('flt_confidence', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT path, ord, confidence FROM findings WHERE confidence > 0.7"""))
def flt_confidence(spark, sf):
    return filters.confident(b.findings(spark, sf)).select('path', 'ord', 'confidence')


@query('flt_severity', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT path, ord, severity FROM findings WHERE severity IN ('CRITICAL', 'HIGH')"""))
def flt_severity(spark, sf):
    return b.findings(spark, sf).filter(F.col('severity').isin('CRITICAL', 'HIGH')).select(
        'path', 'ord', 'severity')


# ---- scalar projections --------------------------------------------------------------------
@query('fn_extension', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', body="""
SELECT path, ext AS extension,
  CASE WHEN contains(low, '.') THEN '.' || split(low, '.')[-1] ELSE '' END AS last_dot,
  '.' || split(low, '.')[-1] AS ui FROM named"""))
def fn_extension(spark, sf):
    name = F.col('filename')
    return b.files(spark, sf).select(
        'path', naming.extension(name).alias('extension'),
        naming.last_dot_extension(name).alias('last_dot'), naming.ui_extension(name).alias('ui'))


_WORDS_SQL = ' '.join(f"WHEN {_has(words)} THEN {quoted(lang)}" for words, lang in languages.NAME_WORDS)


@query('fn_language_full', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', body=f"""
SELECT path, coalesce({_map(languages.FULL_EXTENSIONS, 'ext')}, {_map(languages.FULL_NAMES, 'low')},
  CASE WHEN ext = '' THEN CASE {_WORDS_SQL} END END, 'text') AS language FROM named"""))
def fn_language_full(spark, sf):
    return b.files(spark, sf).select('path', naming.language_full(F.col('filename')).alias('language'))


@query('fn_language_repo', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', body=f"""
SELECT path, {_REPO_LANGUAGE} AS language FROM named"""))
def fn_language_repo(spark, sf):
    return b.files(spark, sf).select('path', naming.language_repo(F.col('filename')).alias('language'))


_MARKERS_SQL = ' '.join(f"WHEN contains(lower(content), {quoted(m)}) THEN {quoted(lang)}"
                        for m, lang in languages.CONTENT_MARKERS)
_SNIPPET_FIRST = ("SELECT path, doc_id, CASE doc_id % 4 WHEN 0 THEN 'f' || doc_id WHEN 1 THEN 'Makefile' "
                  "WHEN 2 THEN filename ELSE '.gitignore' END AS filename, "
                  "content FROM code_files")


@query('fn_language_content', sql=with_sql(b.CODE_SQL, f'heads AS ({_SNIPPET_FIRST})', body=f"""
SELECT path, coalesce({_map(languages.CONTENT_EXTENSIONS,
  "CASE WHEN contains(filename, '.') THEN '.' || split(lower(filename), '.')[-1] ELSE '' END")},
  CASE WHEN lower(filename) IN {_in(languages.CONTENT_NAMES)} THEN lower(filename) END,
  CASE {_MARKERS_SQL} END, 'unknown') AS language FROM heads"""))
def fn_language_content(spark, sf):
    k = F.col('doc_id') % 4
    heads = b.code_files(spark, sf).select(
        'path', F.when(k == 0, F.concat(F.lit('f'), F.col('doc_id').cast('string')))
        .when(k == 1, 'Makefile').when(k == 2, F.col('filename')).otherwise('.gitignore')
        .alias('filename'),
        'content')
    return heads.select('path', naming.language_content(F.col('filename'), F.col('content'))
                        .alias('language'))


def _display(i, default):
    both = {**languages.DISPLAY_EXTENSIONS, **languages.DISPLAY_NAMES}
    return f"coalesce({_map({k: v[i] for k, v in both.items()}, 'key')}, {quoted(default)})"


_KEYED = (f"SELECT *, CASE WHEN low IN {_in(languages.DISPLAY_NAMES)} THEN low "
          "ELSE '.' || split(low, '.')[-1] END AS key FROM named")


@query('fn_language_display', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', f'keyed AS ({_KEYED})', body=f"""
SELECT path, {_display(0, 'Code')} AS display_name, {_display(1, '#6c757d')} AS colour,
  {_display(2, 'Other')} AS category FROM keyed"""))
def fn_language_display(spark, sf):
    return naming.with_display(b.files(spark, sf)).select('path', 'display_name', 'colour', 'category')


_STATS_SQL = f"""
SELECT path, CAST(length(content) AS BIGINT) AS size_bytes, CAST(strlen(content) AS BIGINT) AS octets,
  CAST(length(content) AS BIGINT) AS char_count,
  CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_count,
  CAST(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\\t-\\r\\x1c-\\x20]'))) AS BIGINT)
    AS non_empty_lines,
  CAST(len(regexp_extract_all(content, '[^\\t-\\r\\x1c-\\x20]+')) AS BIGINT) AS word_count,
  regexp_matches(content, '[^\\t-\\r\\x1c-\\x20]') AS has_content FROM code_files"""


@query('fn_file_stats', sql=with_sql(b.CODE_SQL, body=_STATS_SQL))
def fn_file_stats(spark, sf):
    stats = text.file_stats(F.col('content'))
    return b.code_files(spark, sf).select('path', *[c.alias(n) for n, c in stats.items()])


COMPLEXITY_SQL = f"""CAST(CASE WHEN len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\\t-\\r\\x1c-\\x20]'))) > 0
  THEN least((""" + ' + '.join(
    f"(length(lower(content)) - length(replace(lower(content), '{k}', ''))) // {len(k)}"
    for k in text.COMPLEXITY_KEYWORDS) + """) * 10 // len(list_filter(string_split(content, chr(10)),
   lambda x: regexp_matches(x, '[^\\t-\\r\\x1c-\\x20]'))), 100) ELSE 0 END AS BIGINT)"""


@query('fn_complexity', sql=with_sql(b.CODE_SQL, body=f'SELECT path, {COMPLEXITY_SQL} AS complexity FROM code_files'))
def fn_complexity(spark, sf):
    return b.code_files(spark, sf).select('path', text.complexity(F.col('content')).alias('complexity'))


NUMBERED_SQL = """list_transform(string_split(content, chr(10)), lambda x, i:
  (CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, ' ') ELSE CAST(i AS VARCHAR) END) || ': ' || x)"""


@query('fn_number_lines', sql=with_sql(b.CODE_SQL, body=f"""
SELECT path, md5(array_to_string({NUMBERED_SQL}, chr(10))) AS numbered_md5 FROM code_files"""))
def fn_number_lines(spark, sf):
    return b.code_files(spark, sf).select(
        'path', F.md5(text.number_lines(F.col('content'))).alias('numbered_md5'))


PARTS_SQL = f"""CASE WHEN length(array_to_string({NUMBERED_SQL}, chr(10))) > {limits.PROMPT_MAX_CHARS}
  THEN list_transform(generate_series(1, len(string_split(content, chr(10))), {limits.PROMPT_PART_LINES}),
    lambda s: array_to_string(({NUMBERED_SQL})[s:s + {limits.PROMPT_PART_LINES - 1}], chr(10)))
  ELSE [array_to_string({NUMBERED_SQL}, chr(10))] END"""
PARTED_SQL = f"""parted AS (SELECT path, language, unnest(parts) AS t, unnest(generate_series(1, len(parts))) AS part
  FROM (SELECT path, language, {PARTS_SQL} AS parts FROM code_files))"""


@query('fn_truncate', sql=with_sql(b.CODE_SQL, PARTED_SQL, body="""
SELECT path, part, length(t) AS n_chars, md5(t) AS text_md5 FROM parted"""))
def fn_truncate(spark, sf):
    parts = text.rows_of(b.code_files(spark, sf), ['path'], text.prompt_parts(F.col('content')), 't', 'part')
    return parts.select('path', (F.col('part') + 1).cast('bigint').alias('part'),
                        F.length('t').cast('bigint').alias('n_chars'), F.md5('t').alias('text_md5'))


_PROMPT_CASE = ("CASE language WHEN 'python' THEN 'Review Python' WHEN 'java' THEN 'Review Java' "
                "WHEN 'javascript' THEN 'Review JavaScript' ELSE 'Review code' END")
PROMPTS = [('python', 'Review Python'), ('java', 'Review Java'), ('javascript', 'Review JavaScript'),
           ('default', 'Review code')]
PROMPT_SQL = (f"{_PROMPT_CASE} || {quoted(prompts.CODE_HEADER)} || language || chr(10) || t || {quoted(prompts.TRAILER)}")


@query('fn_prompt', sql=with_sql(b.CODE_SQL, PARTED_SQL, body=f"""
SELECT path, part, length(p) AS n_chars, md5(p) AS prompt_md5 FROM (SELECT path, part, {PROMPT_SQL} AS p FROM parted)"""))
def fn_prompt(spark, sf):
    dim = spark.createDataFrame(PROMPTS, 'language string, instruction string')
    made = prompts.build(b.code_files(spark, sf), dim)
    return made.select('path', F.col('part').cast('bigint').alias('part'), F.length('prompt').cast('bigint').alias('n_chars'),
                       F.md5('prompt').alias('prompt_md5'))


@query('join_prompt_dim', sql=with_sql(b.CODE_SQL, body=f"""
SELECT path, {_PROMPT_CASE} AS instruction FROM code_files"""))
def join_prompt_dim(spark, sf):
    dim = spark.createDataFrame(PROMPTS, 'language string, instruction string')
    return prompts.with_instruction(b.code_files(spark, sf), dim).select('path', 'instruction')


@query('join_language_dim', sql=with_sql(b.FILES_SQL, f'named AS ({_NAMED})', body=f"""
SELECT path, coalesce({_map(languages.FULL_EXTENSIONS, 'ext')}, 'text') AS language FROM named"""))
def join_language_dim(spark, sf):
    files = b.files(spark, sf).select('path', naming.extension(F.col('filename')).alias('ext'))
    return files.join(F.broadcast(naming.language_dim(spark)), 'ext', 'left').select(
        'path', F.coalesce('language', F.lit('text')).alias('language'))


_KNOWN = _has(names.REPO_HOSTS, 'clean')
_PUBLIC = "string_split(replace(replace(url, 'https://github.com/', ''), '.git', ''), '/')"


@query('fn_repo_parts', sql=with_sql(b.REPOS_SQL, r"cleaned AS (SELECT *, regexp_replace(url, '\.git$', '') AS clean FROM repos)", body=f"""
SELECT page_id, CASE WHEN {_KNOWN} THEN string_split(clean, '/')[-2] END AS owner,
  string_split(clean, '/')[-1] AS name, {_KNOWN} AS supported,
  CASE WHEN contains(url, 'github.com') AND len({_PUBLIC}) >= 2 THEN {_PUBLIC}[1] END AS public_owner,
  CASE WHEN contains(url, 'github.com') AND len({_PUBLIC}) >= 2 THEN {_PUBLIC}[2] END AS public_name
FROM cleaned"""))
def fn_repo_parts(spark, sf):
    parts = naming.repo_parts(F.col('url'))
    return b.repos(spark, sf).select('page_id', *[c.alias(n) for n, c in parts.items()])


@query('fn_commit_short', sql=with_sql(b.COMMITS_SQL, body="""
SELECT repo, left(sha, 8) AS short_sha, split_part(message, chr(10), 1) AS subject,
  strftime(date, '%Y-%m-%dT%H:%M:%S') AS iso_date FROM commits"""))
def fn_commit_short(spark, sf):
    parts = naming.commit_short(F.col('sha'), F.col('message'), F.col('date'))
    return b.commits(spark, sf).select('repo', *[c.alias(n) for n, c in parts.items()])


NOW = '2024-01-31 00:00:00'
_CREATED = "CASE WHEN event_id % 10 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"
_SECONDS = f"CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(try_cast(created AS TIMESTAMP)) AS DOUBLE) / 1e6"


@query('fn_elapsed', sql=f"""
SELECT event_id, CASE WHEN s < 60 THEN s ELSE s / 60 END AS elapsed_value,
  CASE WHEN s IS NULL THEN 'Unknown' WHEN s < 60 THEN 'seconds' ELSE 'minutes' END AS elapsed_unit
FROM (SELECT event_id, {_SECONDS} AS s FROM (SELECT event_id, {_CREATED} AS created FROM events))""")
def fn_elapsed(spark, sf):
    e = b.table(spark, sf, 'events')
    created = F.when(F.col('event_id') % 10 == 0, 'not a time').otherwise(
        F.date_format('ts', "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    parts = risk.elapsed(created, F.lit(NOW).cast('timestamp_ntz'))
    return e.select('event_id', *[parts[n].alias(n) for n in ('elapsed_value', 'elapsed_unit')])


@query('fn_progress', sql=with_sql(b.SCAN_LOG_SQL, body=f"""
SELECT event_id, CAST(CASE WHEN status = 'completed' THEN 100 WHEN status = 'failed' THEN 0
  WHEN progress > 0 THEN progress
  ELSE least(CAST(trunc(CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) AS DOUBLE) / 1e6
    / nullif(file_count * 45 * 2000, 0) * 100) AS BIGINT), 85) END AS BIGINT) AS progress FROM scan_log"""))
def fn_progress(spark, sf):
    log = b.scan_log(spark, sf)
    value = risk.history_progress(F.col('ts'), F.lit(NOW).cast('timestamp_ntz'), F.col('status'),
                                  F.col('progress'), F.col('file_count') * 2000)
    return log.select('event_id', value.alias('progress'))


@query('fn_severity_rank', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT ord, CAST(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2
  WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END AS BIGINT) AS report_rank,
  CAST(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3
  WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 END AS BIGINT) AS ui_rank FROM findings"""))
def fn_severity_rank(spark, sf):
    return b.findings(spark, sf).select('ord', risk.report_rank(F.col('severity')).alias('report_rank'),
                                        risk.ui_rank(F.col('severity')).alias('ui_rank'))


@query('fn_alert_payload', sql=with_sql(b.HISTORY_SQL, body="""
SELECT ord, 'Security Alert: repo' || repo_id || ' — ' || critical || ' critical, ' || high || ' high' AS title,
  'Repository repo' || repo_id || ' has critical/high findings. Critical: ' || critical || ', High: ' || high
    || '.' || CASE WHEN ord % 2 = 0 THEN chr(10) || '<http://r/' || ord || '|View details>' ELSE '' END AS text,
  CASE WHEN critical > 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  CASE WHEN critical > 0 THEN '#dc3545' ELSE '#fd7e14' END AS colour
FROM history WHERE critical > 0 OR high > 0"""))
def fn_alert_payload(spark, sf):
    h = b.history(spark, sf).filter((F.col('critical') > 0) | (F.col('high') > 0))
    link = F.when(F.col('ord') % 2 == 0, F.concat(F.lit('http://r/'), F.col('ord').cast('string')))
    repo = F.concat(F.lit('repo'), F.col('repo_id').cast('string'))
    parts = risk.alert_payload(repo, F.col('critical'), F.col('high'), link)
    return h.select('ord', *[c.alias(n) for n, c in parts.items()])


@query('fn_display', sql=with_sql(b.FINDINGS_SQL, body="""
SELECT ord, replace(vulnerability_type, '_', ' ') AS type_label,
  CAST(round(confidence * 100) AS BIGINT) AS confidence_percent,
  CASE WHEN length(path || description) > 15 THEN left(path || description, 12) || '...'
       ELSE path || description END AS label,
  CAST(length(description) * 1000 AS DOUBLE) / 1024 AS size_kb FROM findings"""))
def fn_display(spark, sf):
    size = (F.length('description') * 1000).cast('double') / 1024
    return b.findings(spark, sf).select(
        'ord', risk.type_label(F.col('vulnerability_type')).alias('type_label'),
        risk.confidence_percent(F.col('confidence')).alias('confidence_percent'),
        risk.short_label(F.concat('path', 'description')).alias('label'), size.alias('size_kb'))


@query('fn_colour_icon', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT ord, coalesce({_map(sev.UI_COLOURS, 'severity')}, '#6c757d') AS ui_colour,
  coalesce({_map(sev.ALERT_COLOURS, "upper(coalesce(severity, 'INFO'))")}, '#6c757d') AS alert_colour,
  coalesce({_map(sev.TYPE_ICONS, 'vulnerability_type')}, {quoted(sev.DEFAULT_ICON)}) AS icon,
  CASE WHEN line_number % 6 >= 3 THEN '#FF3B30' WHEN line_number % 6 = 2 THEN '#FF9500'
       WHEN line_number % 6 = 1 THEN '#FFD60A' ELSE '#34C759' END AS heat FROM findings"""))
def fn_colour_icon(spark, sf):
    return b.findings(spark, sf).select(
        'ord', risk.ui_colour(F.col('severity')).alias('ui_colour'),
        risk.alert_colour(F.col('severity')).alias('alert_colour'),
        risk.type_icon(F.col('vulnerability_type')).alias('icon'),
        risk.heat_colour(F.col('line_number') % 6).alias('heat'))


_RAW_TYPE = "' ' || lower(vulnerability_type) || chr(9) || ' '"


@query('fn_norm_type', sql=with_sql(b.FINDINGS_SQL, body=f"""
SELECT ord, upper({STRIP_SQL.format(_RAW_TYPE)}) AS type FROM findings"""))
def fn_norm_type(spark, sf):
    raw = F.concat(F.lit(' '), F.lower('vulnerability_type'), F.lit('\t '))
    return b.findings(spark, sf).select('ord', text.normalize_type(raw).alias('type'))


@query('fn_cvss_bucket', sql=with_sql(b.ADVISORIES_SQL, r"""scored AS (SELECT id, list_filter(list_transform(
  list_filter(severity, lambda s: s.type IN ('CVSS_V3', 'CVSS_V2')),
  lambda s: try_cast(split_part(s.score, '/', 1) AS DOUBLE)), lambda x: x IS NOT NULL)[1] AS score FROM advisories)""", body="""
SELECT id, CASE WHEN score IS NULL OR isnan(score) THEN 'LOW' WHEN score >= 9 THEN 'CRITICAL'
  WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM scored"""))
def fn_cvss_bucket(spark, sf):
    return b.advisories(spark, sf).select('id', risk.cvss_bucket(F.col('severity')).alias('bucket'))
