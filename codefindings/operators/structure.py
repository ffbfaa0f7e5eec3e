"""Code structure: imports, functions, classes and the import graph, from anchored patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codefindings.functions.naming import extension
from codefindings.functions.text import complexity, java_pattern, rows_of
from codefindings.operators.pysource import symbols_of
from codefindings.operators.scan import capture

# Patterns.
PY_IMPORT_LINE = r'^(?:from\s+([\w\.]+)\s+import|import\s+([\w\.]+))'
JS_IMPORT = r"import\s+(?:[^'\"]+from\s+)?['\"]([^'\"]+)['\"]"
JS_REQUIRE = r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"
JS_FUNCTION = r'(?:function\s+(\w+)|(\w+)\s*=\s*function|(\w+)\s*=\s*\([^)]*\)\s*=>)'
JS_CLASS = r'class\s+(\w+)'
JS_MODULE = r"""(?:import\s+.*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))"""
# Our own line-anchored symbol patterns for Python.
PY_FUNCTION = r'^[ \t]*(async[ \t]+)?def[ \t]+(\w+)[ \t]*\('
PY_CLASS = r'^[ \t]*class[ \t]+(\w+)[ \t]*(?:\(([^)]*)\))?[ \t]*:'
PY_IMPORT = r'^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+))'


def _all(text: Column, pattern: str, group: int, multiline: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern, multiline=multiline)), F.lit(group))


def python_imports(text: Column) -> Column:
    """Distinct sorted top-level modules imported at column 0 ('' for a relative import)."""
    both = F.concat(_all(text, PY_IMPORT_LINE, 1, True), _all(text, PY_IMPORT_LINE, 2, True))
    named = F.filter(both, lambda m: m != '')
    return F.array_sort(F.array_distinct(
        F.transform(named, lambda m: F.split_part(m, F.lit('.'), F.lit(1)))))


def js_imports(text: Column) -> Column:
    """Distinct sorted modules of import statements and require calls."""
    return F.array_sort(F.array_union(_all(text, JS_IMPORT, 1), _all(text, JS_REQUIRE, 1)))


def import_edges(files: DataFrame, keep=('path',), outer: bool = False) -> DataFrame:
    """(file, module) edges; ``outer`` keeps files without imports with a NULL module."""
    language, text = F.lower('language'), F.col('content')
    modules = (F.when(language == 'python', python_imports(text))
               .when(language.isin('javascript', 'typescript'), js_imports(text)))
    if outer:
        return files.select(*keep, F.explode_outer(modules).alias('module'))
    return rows_of(files, keep, modules, 'module')


def degrees(edges: DataFrame) -> DataFrame:
    """Modules by number of importing files, and files by number of imported modules."""
    # The edges of a file are distinct, so counting them is enough; both sides come from one pass.
    ends = edges.select(F.explode(F.array(
        F.struct(F.lit('module').alias('kind'), F.col('module').alias('name')),
        F.struct(F.lit('file').alias('kind'), F.col('path').alias('name')))).alias('e'))
    return ends.groupBy('e.kind', 'e.name').agg(F.count(F.lit(1)).alias('degree'))


def _first(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit('')) for n in names])


def js_functions(files: DataFrame, keep=('path',)) -> DataFrame:
    return capture(files, JS_FUNCTION, 3, keep).select(
        *keep, _first('g1', 'g2', 'g3').alias('name'), F.col('line_number').alias('line_start'), 'ord')


def js_classes(files: DataFrame, keep=('path',)) -> DataFrame:
    return capture(files, JS_CLASS, 1, keep).select(
        *keep, F.col('g1').alias('name'), F.col('line_number').alias('line_start'), 'ord')


def js_module_refs(files: DataFrame, keep=('path',)) -> DataFrame:
    return capture(files, JS_MODULE, 2, keep).select(
        *keep, _first('g1', 'g2').alias('module'),
        F.when(F.col('g1') != '', 'import').otherwise('require').alias('kind'), 'ord')


def py_symbols(files: DataFrame, keep=('path',)) -> DataFrame:
    """Functions (detail: async), classes (detail: has bases) and imports (detail: from-import).

    With line_start, line_end, parent (what it lies in, dotted) and in_class. An import statement is one
    row, named after its first module; ``pysource.structure`` has one per imported name. ``ord`` counts
    the symbols of a kind within a file. What stands in strings and comments is no symbol.
    """
    detail = {'function': lambda s: s['is_async'], 'class': lambda s: F.size(s['bases']) > 0,
              'import': lambda s: s['imported'].isNotNull()}

    def of(kind, every):
        def first(s, i):
            before = F.get(every, i - 1)
            return (s['kind'] == kind) & ~((s['kind'] == 'import') & F.coalesce(
                (before['kind'] == 'import') & (before['line_start'] == s['line_start']), F.lit(False)))
        return F.transform(F.filter(every, first), lambda s, i: F.struct(
            s['kind'].alias('kind'), s['name'].alias('name'), detail[kind](s).alias('detail'), s['line_start'].alias('line_start'),
            s['line_end'].alias('line_end'), s['parent'].alias('parent'), s['in_class'].alias('in_class'), (i + 1).alias('ord')))
    found = files.select(*keep, symbols_of(F.col('content')).alias('_symbols'))
    symbols = F.concat(*[of(kind, F.col('_symbols')) for kind in detail])
    return rows_of(found, keep, symbols, 's').select(*keep, 's.*')


def summary(files: DataFrame, keep=('path',)) -> DataFrame:
    """Per file: numbers of functions, classes and imports (by extension), and complexity.

    A narrow projection: counting needs no positions, so nothing is joined or shuffled.
    """
    text, ext = F.col('content'), extension(F.col('path'))

    def count(js, py):
        return (F.when(ext.isin('.js', '.jsx'), F.regexp_count(text, F.lit(java_pattern(js))))
                .when(ext == '.py', F.regexp_count(text, F.lit(java_pattern(py, multiline=True))))
                .otherwise(0).cast('bigint'))
    return files.select(*keep, count(JS_FUNCTION, PY_FUNCTION).alias('functions'),
                        count(JS_CLASS, PY_CLASS).alias('classes'),
                        count(JS_MODULE, PY_IMPORT).alias('imports'),
                        complexity(text).alias('complexity'))
