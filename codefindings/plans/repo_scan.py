"""The two end-to-end scans: by repository, and staged per file before model analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from codefindings.functions import risk
from codefindings.operators import aggregate, merge, prompts, replies, scan, snapshots
from codefindings.sources.files import discover
from codefindings.sources.scratch import checkpointed


@dataclass
class StagedScan:
    """What the staged scan yields."""
    findings: DataFrame
    prompts: DataFrame
    skipped: DataFrame


KEYS = ['repo', 'path']


def staged(files: DataFrame, instructions: DataFrame, answered: DataFrame) -> StagedScan:
    """Static rules first; only files without a critical finding go on to the model.

    The findings are scanned once and checkpointed; they are small next to the contents, which are
    neither shuffled nor joined: whether a file has a critical finding is known inside its row.

    ``answered`` is the table of model findings (repo, path, ord and the finding columns, plus
    ``failed`` rows for replies that could not be used). A file whose reply failed keeps its static
    findings. ``skipped`` holds repo and path.
    """
    found = checkpointed(scan.findings(files, keep=KEYS).drop('check_name'))
    critical = found.filter('critical_issues').select(*KEYS).distinct()
    usable = answered.join(critical, KEYS, 'left_anti').filter(~F.col('failed')).drop('failed')
    merged = merge.merge(found.drop('critical_issues'), usable)
    return StagedScan(merged, prompts.build(scan.without_critical(files), instructions), critical)


def model_findings(responses: DataFrame) -> DataFrame:
    """Findings of raw model replies (repo, path, reply) in the form :func:`staged` takes."""
    usable = replies.good(replies.parse(responses))
    return replies.findings(usable, KEYS).withColumn('failed', F.lit(False))


def scan_repository(files: DataFrame, dependency_risk: DataFrame, changed: DataFrame | None = None,
                    key: str = 'repo') -> DataFrame:
    """Discover, optionally keep changed files, scan, score and summarize: one row per repository.

    One narrow pass over the contents counts the findings of each file inside its row; what is
    shuffled are per-repository sums, combined map-side. A repository of which only dependencies are
    known has a row too.
    """
    found_files = discover(files, keys=(key,))
    if changed is not None:
        found_files = snapshots.only_changed(found_files, changed, key)
    per_file = scan.file_counts(found_files, keep=(key, 'path', 'language'))
    sums = {'total': 'total', **{c: c for c in aggregate.COUNTS}, 'score': 'file_score'}
    per_repo = per_file.groupBy(key).agg(
        F.count(F.lit(1)).alias('files_discovered'),
        F.count_if(F.col('total') > 0).alias('files_with_issues'),
        F.array_join(F.array_sort(F.collect_set('language')), ',').alias('languages'),
        *[F.sum(c).cast('bigint').alias(name) for c, name in sums.items()])
    numbers = ['files_discovered', 'files_with_issues', 'total', *aggregate.COUNTS, 'file_score', 'dependency_risk']
    return (per_repo.join(dependency_risk, key, 'full_outer').na.fill(0, numbers).na.fill('', ['languages'])
            .withColumn('repo_score', F.col('file_score') + F.col('dependency_risk'))
            .withColumn('risk_level', risk.ladder('repository')))
