"""Operators and queries for preparing language-model training data.

Nothing else in the library imports this package. ``queries()`` and ``oracle_sql()`` list what the
modules under ``llm`` register.
"""
