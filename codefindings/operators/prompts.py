"""Prompt table for batch inference: instruction, numbered code, trailer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codefindings.functions.text import prompt_parts, rows_of

# The frame around the code.
CODE_HEADER = '\n\nSource:\n```'
TRAILER = '\n```\n\nAnswer with the JSON object alone.'
DEFAULT_KEY = 'default'


def with_instruction(files: DataFrame, instructions: DataFrame) -> DataFrame:
    """Join the caller's (language, instruction) table; other languages use its 'default' row.

    Spark broadcasts the table when it is small. The default row is a separate scalar subquery, so
    unmatched files need no second join key.
    """
    default = instructions.filter(F.col('language') == DEFAULT_KEY).select('instruction')
    matched = files.join(instructions.filter(F.col('language') != DEFAULT_KEY), 'language', 'left')
    return matched.withColumn('instruction', F.coalesce('instruction', default.scalar()))


def build(files: DataFrame, instructions: DataFrame) -> DataFrame:
    """One row per part of a file (``part`` from 1): its columns but ``content``, and ``prompt``, a complete request."""
    keep = [c for c in files.columns if c != 'content']
    parts = rows_of(files, keep, prompt_parts(F.col('content')), 'code', 'part')
    prompt = F.concat('instruction', F.lit(CODE_HEADER), 'language', F.lit('\n'), 'code', F.lit(TRAILER))
    return (with_instruction(parts, instructions).withColumn('prompt', prompt)
            .withColumn('part', F.col('part') + 1).drop('code'))
