"""Text and naming expressions against Python."""

import os
import random

from pyspark.sql import functions as F

from codefindings.functions import naming, text
from codefindings.operators import filters

CHARS = ['a', 'B', 'if', 'ELSE', 'elif', 'case', ' ', '\t', '\n', '\r\n', '\x0b', '\x1c', '\x1f', '\x85', '\xa0', ' ',
         ' ', '​', '　', 'é', '漢', '\U0001f600', '\x00', '"']


def samples(n=1200, seed=1):
    rng = random.Random(seed)
    return ['', ' ', '\n', 'a\n'] + [''.join(rng.choices(CHARS, k=rng.randint(0, 25))) for _ in range(n)]


def test_text_functions_equal_python(spark):
    rows = samples()
    df = spark.createDataFrame(list(enumerate(rows)), 'i int, t string')
    stats = text.file_stats(F.col('t'))
    out = df.select('i', text.strip(F.col('t')).alias('strip'), text.number_lines(F.col('t')).alias('numbered'),
                    text.complexity(F.col('t')).alias('complexity'), text.printable_ratio(F.col('t')).alias('ratio'),
                    *[c.alias(k) for k, c in stats.items()]).collect()
    words = ['if', 'else', 'elif', 'for', 'while', 'try', 'catch', 'switch', 'case']
    for r in out:
        t = rows[r.i]
        filled = [line for line in t.split('\n') if line.strip()]
        hits = sum(line.lower().count(w) for line in filled for w in words)
        assert r.strip == t.strip()
        assert r.numbered == '\n'.join(f'{i:3d}: {line}' for i, line in enumerate(t.split('\n'), 1))
        assert r.complexity == (min(hits * 10 // len(filled), 100) if filled else 0)
        assert r.line_count == len(t.split('\n')) and r.non_empty_lines == len(filled)
        assert r.word_count == len(t.split()) and r.has_content == bool(t.strip())
        assert r.size_bytes == len(t) and r.octets == len(t.encode())
        want = sum(c.isprintable() or c.isspace() for c in t[:4096]) / len(t[:4096]) if t.strip() else None
        assert r.ratio == want


def test_long_numbers_and_truncation(spark):
    long = '\n'.join('x' * 20 for _ in range(1500))
    df = spark.createDataFrame([(long,), ('short',)], 't string')
    rows = df.select(text.number_lines(F.col('t')).alias('n'), text.prompt_parts(F.col('t')).alias('c')).collect()
    lines = rows[0].n.split('\n')
    assert lines[8].startswith('  9: ') and lines[998].startswith('999: ') and lines[1499].startswith('1500: ')
    assert '\n'.join(rows[0].c) == rows[0].n and len(rows[0].c) == 8
    assert rows[1].c == ['  1: short']


def test_byte_ratio(spark):
    rng = random.Random(2)
    raw = [b'', b'\x00', b'abc\x00', bytes(rng.randrange(256) for _ in range(6000)), ('é' * 3000).encode()]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], 'i int, c binary')
    for r in df.select('i', text.text_ratio(F.col('c')).alias('ratio'), filters.is_text_bytes(F.col('c')).alias('ok')).collect():
        head = raw[r.i]
        want = sum(32 <= c <= 126 or c in (9, 10, 13) for c in head) / len(head) if head else None
        assert r.ratio == want and r.ok == (want is not None and want > 0.7)


def test_extension_equals_splitext(spark):
    names = ['a.py', 'A.PY', '.gitignore', '..x', '..x.y', 'a.', 'a.b.c', '', '.', '...', 'noext', '.a.b', 'x.tar.gz', 'é.É']
    df = spark.createDataFrame([(n,) for n in names], 'n string')
    got = [r.e for r in df.select(naming.extension(F.col('n')).alias('e')).collect()]
    assert got == [os.path.splitext(n.lower())[1] for n in names]


def test_languages(spark):
    names = ['a.cs', 'b.PL', 'c.Rmd', 'Dockerfile', 'CMakeLists.txt', 'myconfig', 'install-me', 'mytests', 'zzz', '', 'a.unknown']
    df = spark.createDataFrame([(n,) for n in names], 'n string')
    full = [r.l for r in df.select(naming.language_full(F.col('n')).alias('l')).collect()]
    assert full == ['unity-csharp', 'prolog', 'rmarkdown', 'dockerfile', 'cmake', 'config', 'script', 'test', 'text', 'text', 'text']
    repo = [r.l for r in df.select(naming.language_repo(F.col('n')).alias('l')).collect()]
    assert repo[:4] == ['csharp', 'unknown', 'unknown', 'unknown']
    content = spark.createDataFrame([('x', 'using System;'), ('x', 'DEF f'), ('x', 'def f'), ('Gemfile', '')], 'n string, c string')
    got = [r.l for r in content.select(naming.language_content(F.col('n'), F.col('c')).alias('l')).collect()]
    assert got == ['unknown', 'python', 'python', 'gemfile']
