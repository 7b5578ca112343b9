"""Queries of this package, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools

from tracemill.llm import ann, jaccard, lm, mixing, pieces, pii, substrings, toxicity, urlrules, vectors
from tracemill.llm.shared import prepare

_MODULES = (pii, toxicity, substrings, vectors, mixing, jaccard, pieces, urlrules, lm, ann)


def _prepared(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _prepared(query) for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
