"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codefindings.llm.common import join_by_key, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each step hangs neighbours on the smallest node they can see and is written to the shared
    folder; the loop ends when a step changes nothing, after about log(longest path) steps. A node
    with very many links is one row per link: its smallest neighbour is found by partial sums and given
    back to its rows where they are.
    """
    def with_least(rows: DataFrame, least: Column) -> DataFrame:
        """Rows (u, v) with m, the smallest of their u's ``least``."""
        facts = stored(rows.groupBy(F.col('u').alias('_u')).agg(least.alias('m'), F.count(F.lit(1)).alias('n')), 'least')
        return join_by_key(rows, facts, 'u', '_u', 'n').drop('n')

    edges = links.select(F.greatest('a', 'b').alias('u'), F.least('a', 'b').alias('v')).filter('u > v').distinct()
    state, before = stored(edges, 'links'), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64('u', 'v').cast('decimal(38,0)'))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = state.unionByName(state.select(F.col('v').alias('u'), F.col('u').alias('v')))
        large = stored(with_least(both, F.min(F.least('u', 'v'))).filter('v > u')
                       .select(F.col('v').alias('u'), F.col('m').alias('v')).distinct(), 'large')
        small = (with_least(large, F.min('v'))
                 .select(F.explode(F.array(F.struct(F.col('v').alias('u'), F.col('m').alias('v')),
                                           F.struct(F.col('u').alias('u'), F.col('m').alias('v')))).alias('e'))
                 .select('e.*').filter('u > v').distinct())
        state = stored(small, 'links')
    stars = state.select(F.col('u').alias('node'), F.col('v').alias('component'))
    return stars.unionByName(state.select(F.col('v').alias('node'), F.col('v').alias('component')).distinct())
