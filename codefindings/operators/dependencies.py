"""Dependency manifests and known advisories."""

from __future__ import annotations

import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from codefindings.functions.risk import cvss_bucket, risk_weight
from codefindings.functions.text import SPACE, bind, java_pattern, rows_of, strip
from codefindings.functions.versions import version_key
from codefindings.operators.intervals import meet
from codefindings.sources.scratch import checkpointed

# Requirement line, ecosystems, package.json sections.
REQUIREMENT = r'^([A-Za-z0-9_.\-]+)\s*(==|>=|<=|~=|!=)?\s*([A-Za-z0-9_.\-]+)?'
SECTIONS = ('dependencies', 'devDependencies', 'peerDependencies')
ANY_VERSION = '*'
_PACKAGE = ['ecosystem', 'name']
_ENTRIES = T.ArrayType(T.StructType().add('ecosystem', 'string').add('name', 'string').add('version', 'string'))


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, r'\r\n|\r|\n', -1), strip)


def _entry(ecosystem: str, name: Column, version: Column) -> Column:
    return F.struct(F.lit(ecosystem).alias('ecosystem'), name.alias('name'), version.alias('version'))


def _requirements(content: Column) -> Column:
    pattern = java_pattern(REQUIREMENT)
    wanted = F.filter(_lines(content), lambda line: (line != '') & ~F.startswith(line, F.lit('#'))
                      & line.rlike(pattern))
    return F.transform(wanted, lambda line: _entry('PyPI', F.regexp_extract(line, pattern, 1), F.coalesce(
        F.nullif(F.regexp_extract(line, pattern, 3), F.lit('')), F.lit(ANY_VERSION))))


def _package_json(content: Column) -> Column:
    """The three dependency sections; NULL for a manifest that does not parse."""
    fields = ', '.join(f'{s} map<string,string>' for s in SECTIONS)
    parsed = F.from_json(content, f'struct<{fields}, broken string>',
                         {'columnNameOfCorruptRecord': 'broken', 'allowSingleQuotes': 'false'})
    none = F.expr('CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)')

    def entries(p):
        pairs = F.flatten(F.array(*[F.coalesce(F.map_entries(p[s]), none) for s in SECTIONS]))
        return F.when(p['broken'].isNull(), F.transform(pairs, lambda e: _entry(
            'npm', e['key'], F.coalesce(e['value'], F.lit('None')))))
    return bind(parsed, entries)


def _toml_entries(text: str, targets: bool) -> list[dict] | None:
    """name and version of the dependencies of a Cargo manifest; None for one that is not TOML."""
    try:
        manifest = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return None
    tables = [manifest.get('dependencies')]
    if targets and isinstance(manifest.get('target'), dict):
        tables += [t.get('dependencies') for t in manifest['target'].values() if isinstance(t, dict)]
    found = []
    for table in tables:
        for name, given in table.items() if isinstance(table, dict) else ():
            version = given.get('version') or ANY_VERSION if isinstance(given, dict) else given
            found.append({'ecosystem': 'crates.io', 'name': name, 'version': str(version)})
    return found


def _cargo_toml(content: Column, targets: bool = False) -> Column:
    """Entries of [dependencies], in whatever form TOML allows; with ``targets`` of [target.*.dependencies] too.

    TOML has no reader in the JVM: the contents handed over go through an Arrow function.
    """
    @F.arrow_udf(_ENTRIES)
    def read(contents: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _toml_entries(t, targets) for t in contents.to_pylist()],
                        to_arrow_type(_ENTRIES))
    return read(content)


def _go_mod(content: Column) -> Column:
    """First two words of every line that is no comment and no module line."""
    wanted = F.filter(_lines(content), lambda line: (line != '') & ~F.startswith(line, F.lit('//'))
                      & ~F.startswith(line, F.lit('module ')))
    words = F.transform(wanted, lambda line: F.split(
        strip(F.replace(line, F.lit('require '), F.lit(''))), f'[{SPACE}]+', -1))
    return F.transform(F.filter(words, lambda w: F.size(w) >= 2), lambda w: _entry('Go', w[0], w[1]))


def _parsed(manifests: DataFrame, keep, entries: Column) -> DataFrame:
    return rows_of(manifests, keep, entries, 'd').select(*keep, 'd.*')


def requirements(manifests: DataFrame, keep=('repo', 'manifest')) -> DataFrame:
    return _parsed(manifests, keep, _requirements(F.col('content')))


def package_json(manifests: DataFrame, keep=('repo', 'manifest')) -> DataFrame:
    return _parsed(manifests, keep, _package_json(F.col('content')))


def cargo_toml(manifests: DataFrame, keep=('repo', 'manifest'), targets: bool = False) -> DataFrame:
    """Dependencies of Cargo manifests; ``targets`` adds those of [target.….dependencies]. What is no TOML gives none."""
    return _parsed(manifests, keep, _cargo_toml(F.col('content'), targets))


def go_mod(manifests: DataFrame, keep=('repo', 'manifest')) -> DataFrame:
    return _parsed(manifests, keep, _go_mod(F.col('content')))


def all_dependencies(manifests: DataFrame, keep=('repo', 'manifest')) -> DataFrame:
    """Dependencies of every supported manifest, chosen by file name; lock files give none.

    One pass over the manifests. Only Cargo texts are handed to the TOML reader, as a column that is NULL
    for all others.
    """
    name, content = F.lower(F.substring_index('filename', '/', -1)), F.col('content')
    cargo = name == 'cargo.toml'
    entries = (F.when(name == 'requirements.txt', _requirements(content))
               .when(name == 'package.json', _package_json(content))
               .when(name == 'go.mod', _go_mod(content))
               .when(cargo, _cargo_toml(F.when(cargo, content))))
    return _parsed(manifests, keep, entries)


def advisories_for(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisories of each dependency: those listing its version or having it in a range, or all for version '*'.

    ``advisories`` has versions, an array, and may have ranges, an array of (introduced, fixed): from the
    first on, before the second; a NULL is open, and introduced '0' too. Versions that are none, such as
    '^1.2', are met by lists only. Duplicated dependencies give duplicated hits. Listed versions, and '*' for
    all, become join keys, so a widely used package with many advisories is not paired with all of them
    first; ranges become versions by :func:`intervals.meet`. The join is a sort-merge, which spills and which Spark
    splits at skewed keys at run time: by size it would broadcast a row per advisory and version, as its estimate
    does not count what ``explode`` adds.
    """
    if 'ranges' in advisories.columns:
        # Read twice and costly to parse; most dependencies are of packages no advisory is about.
        dependencies = checkpointed(dependencies.join(advisories.select(*_PACKAGE).distinct(), _PACKAGE, 'left_semi'))
    return dependencies.join(_by_version(dependencies, advisories).hint('merge'), [*_PACKAGE, 'version'])


def _by_version(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Facts of the advisories, a row per version they are about, '*' included; of ranges the versions in use only."""
    facts = [*_PACKAGE, 'id', 'summary', 'severity']
    known = advisories.withColumn('severity', cvss_bucket(F.col('severity')))
    listed = rows_of(known.withColumn('versions', F.array_union(
        F.coalesce('versions', F.expr('CAST(array() AS ARRAY<STRING>)')), F.array(F.lit(ANY_VERSION)))), facts, F.col('versions'), 'version')
    if 'ranges' in advisories.columns:
        listed = listed.unionByName(_in_ranges(dependencies, known, facts)).distinct()
    return listed


def _in_ranges(dependencies: DataFrame, known: DataFrame, facts: list[str]) -> DataFrame:
    """``facts`` of the advisories and the versions in use that lie in their ranges; one in two ranges comes twice.

    Versions and ranges of a package are made distinct and stored before they get their keys, as Spark would
    push the test for a key below ``distinct`` and make it for every dependency and advisory. The hint is for
    the reason given in :func:`advisories_for`.
    """
    ranges = rows_of(known, facts, F.col('ranges'), 'span').select(*facts, F.struct(
        F.coalesce(F.col('span.introduced'), F.lit('0')).alias('introduced'), F.col('span.fixed').alias('fixed')).alias('interval'))
    low, high = F.col('interval.introduced'), F.col('interval.fixed')
    spans = checkpointed(ranges.select(*_PACKAGE, 'interval').distinct()).select(
        *_PACKAGE, 'interval', F.when(low == '0', '').otherwise(version_key(low)).alias('low'),
        F.when(high.isNull(), '~').otherwise(version_key(high)).alias('high'))
    used = checkpointed(dependencies.select(*_PACKAGE, 'version').distinct()).withColumn('at', version_key(F.col('version')))
    met = meet(used, spans, _PACKAGE, 'at', 'interval').join(used, [*_PACKAGE, 'at'])
    return ranges.hint('merge').join(met, [*_PACKAGE, 'interval']).select(*facts, 'version')


def risk_by_repo(dependencies: DataFrame, advisories: DataFrame, key: str = 'repo') -> DataFrame:
    """Summed risk weight of the advisories of each dependency, as :func:`advisories_for` finds them; ``key`` with hits only.

    The hits grow with dependencies times advisories of a package, so they are not made: weights are summed per
    version and dependencies counted per ``key`` and version before the two meet.
    """
    version = ['ecosystem', 'name', 'version']
    weights = _by_version(dependencies, advisories).groupBy(*version).agg(F.sum(risk_weight(F.col('severity'))).alias('weight'))
    uses = dependencies.groupBy(key, *version).agg(F.count(F.lit(1)).alias('n'))
    return uses.join(weights, version).groupBy(key).agg(F.sum(F.col('n') * F.col('weight')).cast('bigint').alias('dependency_risk'))
