"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from . import evaluation, evaluation_sql, features, features_sql, oracle, queries

QUERIES = {**queries.QUERIES, **evaluation.QUERIES, **features.QUERIES}
ORACLE = {**oracle.ORACLE, **evaluation_sql.ORACLE, **features_sql.ORACLE}
