"""Text expressions with Python string semantics, all built from JVM-side functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from codefindings.dims import limits

# The characters Python's str.isspace() accepts, as the inside of a Java character class.
SPACE = r'\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}'
# The characters Python's \w accepts.
WORD = r'\p{L}\p{N}_'

# Keywords counted by the complexity score.
COMPLEXITY_KEYWORDS = ['if', 'else', 'elif', 'for', 'while', 'try', 'catch', 'switch', 'case']


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(df: DataFrame, keep, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element (elements are never NULL); empty arrays give no row.

    A plain explode makes the optimizer add a filter on the array's size, which it then pushes below
    projections and exchanges, so that a costly array is computed twice. The outer form has no such
    filter; the NULL row it adds for an empty array is dropped afterwards.
    """
    made = (F.explode_outer(array).alias(name) if position is None
            else F.posexplode_outer(array).alias(position, name))
    return df.select(*keep, made).filter(F.col(name).isNotNull())


class UnsupportedPattern(ValueError):
    """A pattern uses something whose meaning differs between the regular expression engines."""


def translated(pattern: str, classes: dict[str, str], inside: dict[str, str]) -> str:
    r"""``pattern`` with backslash pairs and named groups replaced.

    ``classes`` holds the replacements outside a character class, ``inside`` those within one. A
    ``\b`` next to a literal word character needs to look at one side only.
    """
    out, i, start = [], 0, -1
    while i < len(pattern):
        two, rest = pattern[i:i + 2], pattern[i + 2:]
        if two[0] == '\\':
            table = classes if start < 0 else inside
            if two == r'\b' and start < 0 and re.match('[A-Za-z0-9_]', rest):
                # The literal is looked at first: the look behind would else be tried at every character.
                ahead = '' if re.match('.[?*{]', rest) else f'(?={rest[0]})'
                out.append(ahead + table['word_begins'] if 'word_begins' in table else two)
            elif start >= 0 and two in (r'\W', r'\S', r'\D') and pattern[start:start + 2] == '[^':
                raise UnsupportedPattern(f'{two} in a negated class: {pattern}')
            else:
                out.append(table.get(two, two))
            i += 2
            continue
        if start >= 0:
            if two[0] == ']' and i > start + 1 + (pattern[start + 1:start + 2] == '^'):
                start = -1
            elif two[0] == '[' or two == '&&':
                out.append('\\')
        elif two[0] == '[':
            start = i
        elif two == '(?':
            named = re.match(r'\(\?P<(\w+)>|\(\?P=(\w+)\)', pattern[i:])
            if named:
                if '_' in named.group():
                    raise UnsupportedPattern(f'underscore in a group name: {pattern}')
                out.append(f'(?<{named[1]}>' if named[1] else f'\\k<{named[2]}>')
                i += named.end()
                continue
            if re.match(r'\(\?[aLu(]', pattern[i:]):
                raise UnsupportedPattern(pattern)
        out.append(two[0])
        i += 1
    return ''.join(out)


# Python's meaning of the classes and anchors, in Java's words.
_BOUNDARY = f'(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))'
# An empty text has no place that is not a boundary.
_NO_BOUNDARY = f'(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}])(?!\\A\\z))'
_JAVA = {r'\s': f'[{SPACE}]', r'\S': f'[^{SPACE}]', r'\w': f'[{WORD}]', r'\W': f'[^{WORD}]', r'\d': r'\p{Nd}',
         r'\D': r'\P{Nd}', r'\b': _BOUNDARY, r'\B': _NO_BOUNDARY, r'\Z': r'\z', 'word_begins': f'(?<![{WORD}])'}
_JAVA_INSIDE = {r'\s': SPACE, r'\S': f'[^{SPACE}]', r'\w': WORD, r'\W': f'[^{WORD}]', r'\d': r'\p{Nd}',
                r'\D': r'\P{Nd}', r'\b': r'\x08'}


def java_pattern(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    r"""The Java pattern matching what Python's ``re`` matches for ``pattern``.

    Classes, word boundaries, ``\Z`` and named groups are spelled out with Python's meaning, and only
    a line feed ends a line (flag ``d``). What has no equal (inline ASCII and locale flags,
    conditionals, a negated shorthand inside a negated class) raises :class:`UnsupportedPattern`.
    """
    flags = 'd' + ('iu' if ignore_case else '') + ('m' if multiline else '')
    return f'(?{flags})' + translated(pattern, _JAVA, _JAVA_INSIDE)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f'^[{SPACE}]+|[{SPACE}]+\\z', '')


def is_blank(text: Column) -> Column:
    return ~text.rlike(f'[^{SPACE}]')


def lines(text: Column) -> Column:
    return F.split(text, '\n', -1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f'[^{SPACE}]+')).cast('bigint')


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(F.replace(text, F.lit(literal), F.lit('')))
    return ((F.length(text) - gone) / F.lit(len(literal))).cast('bigint')


def non_empty_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda line: ~is_blank(line))).cast('bigint')


def complexity(text: Column) -> Column:
    """Keyword occurrences times ten per non-empty line, at most 100."""
    def score(low):
        total = sum((count_of(low, k) for k in COMPLEXITY_KEYWORDS[1:]),
                    count_of(low, COMPLEXITY_KEYWORDS[0]))
        return bind(non_empty_lines(low), lambda n: F.when(
            n > 0, F.least(F.floor(total * 10 / F.greatest(n, F.lit(1))), F.lit(100)))
            .otherwise(0).cast('bigint'))
    return bind(F.lower(text), score)


def file_stats(text: Column) -> dict[str, Column]:
    """Statistics of one file. ``size_bytes`` is the character count, as in stored results."""
    return {
        'size_bytes': F.length(text).cast('bigint'),
        'octets': F.octet_length(text).cast('bigint'),
        'char_count': F.length(text).cast('bigint'),
        'line_count': F.size(lines(text)).cast('bigint'),
        'non_empty_lines': non_empty_lines(text),
        'word_count': word_count(text),
        'has_content': ~is_blank(text),
    }


def _numbered(text: Column) -> Column:
    def one(line, i):
        n = (i + 1).cast('string')
        return F.concat(F.when(i < 999, F.lpad(n, 3, ' ')).otherwise(n), F.lit(': '), line)
    return F.transform(lines(text), one)


def number_lines(text: Column) -> Column:
    return F.array_join(_numbered(text), '\n')


def prompt_parts(text: Column) -> Column:
    """Numbered text as an array of parts that together hold every line.

    One part, unless the whole is too long for one request: then parts of a fixed number of lines.
    """
    def cut(numbered):
        size = limits.PROMPT_PART_LINES
        many = F.transform(F.sequence(F.lit(1), F.size(numbered), F.lit(size)),
                           lambda start: F.array_join(F.slice(numbered, start, size), '\n'))
        return bind(F.array_join(numbered, '\n'), lambda whole: F.when(
            F.length(whole) > limits.PROMPT_MAX_CHARS, many).otherwise(F.array(whole)))
    return bind(_numbered(text), cut)


def normalize_type(kind: Column) -> Column:
    return F.upper(strip(kind))


def text_ratio(content: Column, sample: int | None = None) -> Column:
    """Share of printable ASCII bytes of the content, or of its first ``sample`` bytes (NULL for empty content)."""
    raw = content.cast('binary')
    head = F.decode(raw if sample is None else F.substring(raw, 1, sample), 'ISO-8859-1')
    return bind(head, lambda s: F.length(F.regexp_replace(s, r'[^\x20-\x7e\t\n\r]', ''))
                / F.nullif(F.length(s), F.lit(0)))


def printable_ratio(text: Column, sample: int | None = None) -> Column:
    """Share of printable or white-space characters of the text, or of its first ``sample`` ones.

    NULL when that part is blank.
    """
    bad = f'[\\p{{C}}\\p{{Z}}&&[^{SPACE}]]'
    return bind(text if sample is None else F.substring(text, 1, sample), lambda s: F.when(
        ~is_blank(s), F.length(F.regexp_replace(s, bad, '')) / F.nullif(F.length(s), F.lit(0))))
