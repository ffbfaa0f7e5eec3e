"""Python structure against the standard library's own parser."""

import ast
import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from codefindings.operators import pysource


def squeezed(parts):
    return [re.sub(r'\s', '', p) for p in parts]


def parsed(text):
    out = []

    def walk(node, scope):
        inside = scope
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(('function', node.name, node.lineno, node.end_lineno, '.'.join(n for n, _ in scope) or None,
                        [a.arg for a in node.args.args], isinstance(node, ast.AsyncFunctionDef)))
            inside = [*scope, (node.name, False)]
        elif isinstance(node, ast.ClassDef):
            out.append(('class', node.name, node.lineno, node.end_lineno, '.'.join(n for n, _ in scope) or None, len(node.bases), None))
            inside = [*scope, (node.name, True)]
        elif isinstance(node, ast.Import):
            out.extend(('import', a.name, node.lineno, node.end_lineno, a.asname, None, None) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.extend(('import', '.' * node.level + (node.module or ''), node.lineno, node.end_lineno, a.asname, a.name, None)
                       for a in node.names)
        for child in ast.iter_child_nodes(node):
            walk(child, inside)
    walk(ast.parse(text), [])
    return out


def shaped(rows):
    return [('function', r['name'], r['line_start'], r['line_end'], r['parent'], r['args'], r['is_async']) if r['kind'] == 'function'
            else ('class', r['name'], r['line_start'], r['line_end'], r['parent'], len(r['bases']), None) if r['kind'] == 'class'
            else ('import', r['name'], r['line_start'], r['line_end'], r['alias'], r['imported'], None) for r in rows]


PIECES = ['x = 1', 's = "def no(a):"', "t = '''\nclass No(B):\n  import no\n'''", '# def not_this(): pass', 'import os, sys as system',
          'from a.b import (c,\n    d as e,  # why\n    f)', 'y = (1,\n2,\n  3)', 'z = [\n"""a\nb""", {\n}]', 'pass', 'w = 1 + \\\n  2',
          'from . import sibling', 'from .. import up as u', 'from .m import *', 'import a; import b.c', 'if x: import late',
          'r = r"\\"; q = \'"\'', '', '   ', "u = f'{x}' 'b'", 'v = "a\\\nb"', 'lambda: 0', '@decorated(1)\ndef g(a, /, b: int = 3, *c, d, **e): return 1']


def made(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.5 or depth > 3:
            out += rng.choice(PIECES).split('\n') if rng.random() < 0.9 else ['# end']
        else:
            head = rng.choice(['def f{}(a, b=[1, 2], *, c=")"):', 'async def g{}(x: "A, B" = (1, 2), *y):', 'class C{}(A, B[x], metaclass=M):', 'class D{}:',
                               'if a == (1 and\n   2):', 'for i in x:', 'def h{}(\n    a,\n    b,\n):', 'with a as b:', 'class E{}():', 'def t{}[T](v: T):'])
            out += head.format(rng.randint(0, 99)).split('\n')
            body = made(rng, depth + 1) + ['pass']
            pad = rng.choice(['  ', '    ', '\t'])
            inside = False
            for line in body:
                out.append(line if inside or line == '' else pad + line)
                inside ^= (line.count("'''") + line.count('"""')) % 2 == 1 or line.endswith('"a\\') or (inside and line == 'b"')
    return out


@pytest.mark.parametrize('seed', range(6))
def test_equals_the_parser_on_made_sources(seed):
    rng, tried = random.Random(seed), 0
    while tried < 150:
        text = '\n'.join(made(rng))
        try:
            want = parsed(text)
        except SyntaxError:
            continue
        tried += 1
        assert sorted(map(str, shaped(pysource.symbols(text)))) == sorted(map(str, want)), text


def test_equals_the_parser_on_the_standard_library():
    files = sorted(glob.glob(os.path.join(os.path.dirname(os.__file__), '*.py')))
    assert len(files) > 100
    for name in files:
        with open(name, encoding='utf-8') as f:
            text = f.read()
        assert sorted(map(str, shaped(pysource.symbols(text)))) == sorted(map(str, parsed(text))), name


def test_broken_sources_keep_what_can_be_read():
    text = 'it\'s (open\ndef f(a):\n  """never closed\n  x\nclass A(B):\n  def g(self): pass\nimport os'
    assert [(r['kind'], r['name'], r['line_start'], r['line_end'], r['in_class']) for r in pysource.symbols(text)] == [
        ('function', 'f', 2, 4, None), ('class', 'A', 5, 6, None), ('function', 'g', 6, 6, 'A'), ('import', 'os', 7, 7, None)]
    assert pysource.symbols('') == [] and pysource.symbols('((((' * 5000 + '\n' * 5000 + 'def f(): pass')[0]['name'] == 'f'


def test_structure_of_files(spark):
    rows = [('a', 'class A(B, k=1):\n    async def f(self, x): pass\n'), ('b', None), ('c', ''), ('a', 'import a as b')]
    files = spark.createDataFrame(rows, 'path string, content string').withColumn('kind', F.lit(1))
    got = [(r.path, r.kind, r.name, r.line_end, r.parent, r.args, r.bases, r.alias, r.ord) for r in pysource.structure(files).collect()]
    assert got == [('a', 'class', 'A', 2, None, None, ['B'], None, 1), ('a', 'function', 'f', 2, 'A', ['self', 'x'], None, None, 2),
                   ('a', 'import', 'a', 1, None, None, None, 'b', 1)]


def test_from_import_ends_an_open_bracket():
    text = 'call +1 (8\nfrom pickle import loads\nfrom . import sibling\nlist[1 (\nfrom ..a import b\nimport os\n'
    assert [(s['name'], s['imported'], s['line_start']) for s in pysource.symbols(text)] == [
        ('pickle', 'loads', 2), ('.', 'sibling', 3), ('..a', 'b', 5), ('os', None, 6)]
    inside = 'def f():\n    x = (yield\n         from g(a,\n from_import))\n    import os\n'
    assert [(s['kind'], s['line_start']) for s in pysource.symbols(inside)] == [('function', 1), ('import', 5)]
