"""Version numbers as text that sorts the way versions do."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codefindings.functions.text import SPACE, bind

# What a part of a version starts with, in the order in which they sort.
_END, _NUMBER, _WORD = '0', '2', '4'
_BEFORE_RELEASE, _RELEASE, _AFTER_RELEASE, _MORE = '1', '3', '4', '5'
_SAME_WORDS = {'alpha': 'a', 'beta': 'b', 'c': 'rc', 'pre': 'rc', 'preview': 'rc', 'dev': '!dev'}
_AFTER_WORDS = ['post', 'rev', 'r']


def _number(digits: Column) -> Column:
    """Digits of any number, led by how many there are."""
    return bind(F.ltrim(digits, F.lit('0')), lambda d: F.concat(F.lpad(F.length(d).cast('string'), 3, '0'), d))


def _word(word: Column) -> Column:
    same = F.lit(None).cast('string')
    for one, other in _SAME_WORDS.items():
        same = F.when(word == one, other).otherwise(same)
    return F.concat(F.coalesce(same, word), F.lit(' '))


def version_key(version: Column) -> Column:
    """A text such that ``a < b`` as versions means ``version_key(a) < version_key(b)``; NULL for what is no version.

    Numbers are compared as numbers of any length, trailing zero parts do not count, pre-releases come before the
    release (development, alpha, beta, candidate), post-releases after it; within them numbers come before words
    and fewer parts first. A leading v or = and build metadata are ignored, case too.
    """
    plain = F.lower(F.regexp_replace(version, f'^[{SPACE}=vV]+|\\+.*|[{SPACE}]+\\z', ''))

    def keyed(v):
        release = F.regexp_extract(v, r'^[0-9]+(?:\.[0-9]+)*', 0)
        parts = F.split(F.regexp_replace(release, r'(?:\.0+)+\z', ''), r'\.', -1)
        main = F.array_join(F.transform(parts, lambda p: F.concat(F.lit(_MORE), _number(p))), '')
        rest = F.regexp_extract_all(F.substr(v, F.length(release) + 1), F.lit('[0-9]+|[a-z]+'), F.lit(0))

        def tail(tokens):
            kind = (F.when(F.size(tokens) == 0, _RELEASE).when(tokens[0].isin(_AFTER_WORDS), _AFTER_RELEASE)
                    .otherwise(_BEFORE_RELEASE))
            each = F.transform(tokens, lambda t: F.when(t.rlike('^[0-9]'), F.concat(F.lit(_NUMBER), _number(t)))
                               .otherwise(F.concat(F.lit(_WORD), _word(t))))
            return F.concat(kind, F.array_join(each, ''), F.lit(_END))
        return F.when(release != '', F.concat(main, bind(rest, tail)))
    return bind(plain, keyed)
