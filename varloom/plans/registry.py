"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import anno_queries, geno_queries, result_queries, score_queries, set_queries, test_queries

PARTS = (geno_queries, anno_queries, set_queries, result_queries, test_queries, score_queries)


def queries() -> dict[str, Callable]:
    return {name: q for part in PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
