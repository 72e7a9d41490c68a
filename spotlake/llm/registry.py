"""Registered queries of this package and the SQL that says the same, where SQL can."""

from spotlake.llm import label_queries, label_sql, number_queries, text_queries
from spotlake.operators.scale import scoped

QUERIES = {**label_queries.QUERIES, **number_queries.QUERIES, **text_queries.QUERIES}
SQL = {**label_sql.SQL, **number_queries.SQL, **text_queries.SQL}


def queries() -> dict:
    return {k: scoped(v) for k, v in QUERIES.items()}


def oracle_sql() -> dict:
    return dict(SQL)
