"""Time the headline queries: medians of three runs after a warm-up. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma
separated names, or 'all') set what runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    'repo_scan', 'scan_all', 'scan_secrets', 'scan_dangerous_calls', 'scan_sql_injection', 'staged_scan',
    'src_files', 'flt_budget', 'fn_file_stats', 'fn_complexity', 'fn_prompt', 'import_fanin',
    'structure_summary', 'deps_advisories', 'snapshot_diff', 'join_merge_findings', 'agg_severity_rollup',
    'agg_executive_summary', 'risk_repository', 'recs_report', 'top_problem_files', 'order_findings',
    'rate_60s', 'min_gap', 'quota_24h', 'latest_status', 'match_ground_truth', 'ai_parse_reply',
    'report_overview', 'stream_scan', 'stream_severity_trend',
]


ENOUGH_SECONDS = 30


def main() -> None:
    from codefindings import catalog
    from tests.session import session
    sf = os.environ.get('BENCH_SF_DIR', '/root/testdata/sf0.1')
    spark = session(os.environ.get('BENCH_CPUS'))
    queries = catalog.queries()
    chosen = os.environ.get('BENCH_QUERIES', '')
    names = list(queries) if chosen == 'all' else [n for n in chosen.split(',') if n] or HEADLINE
    for name in ('agg_types', 'scan_all'):
        queries[name](spark, sf).write.format('noop').mode('overwrite').save()
    times = {}
    for name in names:
        taken = []
        while len(taken) < 3 and sum(taken) < ENOUGH_SECONDS:
            start = time.perf_counter()
            queries[name](spark, sf).write.format('noop').mode('overwrite').save()
            taken.append(time.perf_counter() - start)
        times[name] = round(median(taken), 3)
        print(f'{name} {times[name]} ({len(taken)} runs)', file=sys.stderr, flush=True)
    print(json.dumps({'metric': 'total time of the headline queries', 'value': round(sum(times.values()), 3),
                      'unit': 'sec', 'queries': times, 'sf': sf.rstrip('/').rsplit('sf', 1)[-1]}))
    spark.stop()


if __name__ == '__main__':
    main()
