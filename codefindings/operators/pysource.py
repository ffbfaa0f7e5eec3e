"""The structure of Python sources: functions, classes and imports with their place and nesting.

A small lexer cuts a text into logical lines: strings and comments are taken out, and a line break
inside brackets, inside a string or behind a backslash does not end a line. A stack of indentations then
gives every definition its last line and what it lies in. Unlike a full parser it also reads files that
do not parse: a quote or bracket that is never closed costs its own line only.

The lexer is sequential by nature, so it runs in an Arrow function over the contents handed to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from codefindings.functions.text import rows_of

_TEXTS = T.ArrayType(T.StringType())
SYMBOL = (T.StructType().add('kind', 'string').add('name', 'string').add('line_start', 'long').add('line_end', 'long')
          .add('parent', 'string').add('in_class', 'string').add('is_async', 'boolean').add('args', _TEXTS)
          .add('bases', _TEXTS).add('alias', 'string').add('imported', 'string'))

TOKEN = re.compile(r'''
    (?P<string>[A-Za-z]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*\'\'\'
              |"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))
  | (?P<comment>\#[^\n]*) | (?P<joined>\\\r?\n) | (?P<line>\n)
  | (?P<open>[(\[{]) | (?P<close>[)\]}]) | (?P<word>\w+) | (?P<blank>[^\S\n]+) | (?P<other>.)''', re.X | re.S)
#: Words that only ever begin a statement: they end brackets left open.
BEGINS = {'def', 'class', 'import', 'async', 'return', 'while', 'try', 'with', 'raise', 'del', 'global', 'pass'}
#: ``from`` stands in brackets too (yield from), but never with an import behind it.
FROM_IMPORT = re.compile(r'from[ \t]+[\w.]+[ \t]+import\b|from[ \t]*\.[\w. \t]*\bimport\b')
DEFINITION = re.compile(r'(async\s+)?def\s+(\w+)|class\s+(\w+)')
IMPORT = re.compile(r'(?:^|[:;])\s*(?:from\s*([\w.]+|\.+\s*[\w.]*)\s*import\b|import\b)([^;]*)')


class Line(NamedTuple):
    """A logical line: first and last line number, indentation, and code with strings as ``''``."""
    start: int
    end: int
    indent: int
    code: str


def logical_lines(text: str) -> Iterator[Line]:
    number, depth, parts, start, end, indent, column = 1, 0, [], 0, 0, 0, 0
    for m in TOKEN.finditer(text):
        kind, own = m.lastgroup, m.group()
        breaks = own.count('\n') if kind in ('string', 'joined', 'line') else 0
        begins = kind == 'word' and depth and (own in BEGINS or (own == 'from' and FROM_IMPORT.match(text, m.start())))
        if begins and ''.join(parts).rstrip(' \t').endswith('\n'):
            yield Line(start, end, indent, _code(parts))
            depth, parts = 0, []
        if kind == 'line' and not depth:
            if parts:
                yield Line(start, end, indent, _code(parts))
            parts = []
        elif kind in ('line', 'joined'):
            if parts:
                parts.append('\n' if kind == 'line' else ' ')
        elif kind == 'blank':
            if parts:
                parts.append(own)
        elif kind != 'comment':
            if not parts:
                start, indent = number, column
            depth = max(0, depth + (kind == 'open') - (kind == 'close'))
            parts.append("''" if kind == 'string' else own)
            end = number + breaks
        number += breaks
        if breaks:
            column = 0
        elif kind == 'blank':
            for c in own:
                column = column // 8 * 8 + 8 if c == '\t' else 0 if c == '\f' else column + 1
        else:
            column += len(own)
    if parts:
        yield Line(start, end, indent, _code(parts))


def _code(parts: list[str]) -> str:
    return ''.join(parts).strip()


def _bracketed(code: str, at: int) -> list[str]:
    """The comma-separated parts of the bracket pair that opens at ``at``."""
    depth, begun, out = 0, at + 1, []
    for i in range(at, len(code)):
        depth += (code[i] in '([{') - (code[i] in ')]}')
        if not depth or (depth == 1 and code[i] == ','):
            out.append(re.sub(r'\s+', ' ', code[begun:i]).strip())
            begun = i + 1
        if not depth:
            break
    return [part for part in out if part]


def _given(code: str, at: int) -> list[str]:
    """The parts of the round brackets behind a name, type parameters before them skipped."""
    m = re.compile(r'\s*(?:\[[^\]]*\]\s*)?\(').match(code, at)
    return _bracketed(code, m.end() - 1) if m else []


def _arguments(parts: list[str]) -> list[str]:
    """Names that may be given by position or by name."""
    out: list[str] = []
    for part in parts:
        if part == '/':
            out = []
        elif part.startswith('*'):
            break
        else:
            out.append(re.match(r'\w*', part).group())
    return out


def symbols(text: str) -> list[dict]:
    """The symbols of a source in the order in which they begin."""
    found: list[dict] = []
    stack: list[tuple[int, dict]] = []
    last = 0

    def add(line: Line, kind: str, name: str, **more) -> dict:
        classes = [s['name'] for _, s in stack if s['kind'] == 'class']
        row = {'kind': kind, 'name': name, 'line_start': line.start, 'line_end': line.end, 'args': None, 'bases': None,
               'parent': '.'.join(s['name'] for _, s in stack) or None, 'in_class': classes[-1] if classes else None,
               'is_async': None, 'alias': None, 'imported': None, **more}
        found.append(row)
        return row

    for line in logical_lines(text.replace('\r\n', '\n')):
        while stack and stack[-1][0] >= line.indent:
            stack.pop()[1]['line_end'] = last
        last = line.end
        m = DEFINITION.match(line.code)
        if m and m[3]:
            bases = [p for p in _given(line.code, m.end()) if not re.match(r'\w+ ?=(?!=)|\*\*', p)]
            stack.append((line.indent, add(line, 'class', m[3], bases=bases)))
        elif m:
            args = _arguments(_given(line.code, m.end()))
            stack.append((line.indent, add(line, 'function', m[2], args=args, is_async=bool(m[1]))))
        for m in IMPORT.finditer(line.code) if 'import' in line.code else ():
            names = re.sub(r'[()]|\s+', ' ', m[2]).split(',')
            for name in filter(None, map(str.strip, names)):
                what, _, alias = name.partition(' as ')
                if not re.fullmatch(r'[\w.]+(?: \.[\w.]*)*|\*', what.strip()):
                    continue
                from_ = m[1] and m[1].replace(' ', '')
                add(line, 'import', from_ or what.strip(), alias=alias.strip() or None, imported=what.strip() if from_ else None)
    for _, row in stack:
        row['line_end'] = last
    return found


_ARROW = to_arrow_type(T.ArrayType(SYMBOL))


@F.arrow_udf(T.ArrayType(SYMBOL))
def _symbols(content: pa.Array) -> pa.Array:
    return pa.array([None if t is None else symbols(t) for t in content.to_pylist()], _ARROW)


def symbols_of(content: Column) -> Column:
    """All symbols of a Python source; NULL for NULL."""
    return _symbols(content)


def structure(files: DataFrame, keep=('path',)) -> DataFrame:
    """One row per function, class and imported name of Python files.

    ``keep`` plus kind, name (of an import: the module as written), line_start, line_end, parent (what
    it lies in, dotted; NULL at the top), in_class (the class next around it), is_async, args (those that
    may be given by position or name), bases (without keyword arguments; strings in them read ``''``),
    alias, imported (the name taken from a module) and ord, its number in the file.
    """
    return rows_of(files, keep, symbols_of(F.col('content')), 's', 'at').select(
        *keep, 's.*', (F.col('at') + 1).alias('ord'))
