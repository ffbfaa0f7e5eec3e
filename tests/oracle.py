"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ('region nation customer supplier part orders lineitem events documents embeddings pages '
          'benchmark labels conversations').split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ''
    if isinstance(value, float):
        return repr(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, function, sql, sf):
    """None when equal, otherwise a short account of the difference."""
    df = function(spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else 'no rows'
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f'columns {got[0]} != {want[0]}'
    if not got[1]:
        return 'no rows'
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return f'{len(got[1])} rows, SQL {len(want[1])}; only here {only}; missing {missing}'
    return None


def main():
    import __spark_entry__ as entry
    from tests.session import session
    sf = '/root/testdata/sf0.01'
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not sys.argv[1:] or any(q.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as error:
            problem = f'{type(error).__name__}: {str(error)[:600]}'
        bad += problem is not None
        note = 'ok' if problem is None else 'DIFF ' + problem
        print(f'{name:28s} {time.time() - start:6.2f}s {"sql" if name in oracles else "rows"} {note}', flush=True)
    print(f'{len(wanted)} queries, {bad} bad')


if __name__ == '__main__':
    main()
