"""Composed queries over the test tables, each with its SQL where SQL can express it."""

from quillon.plans import annotation, detection, evaluation, masks, relational, selection, shapes, streams, video  # noqa: F401  each adds its queries

QUERIES = relational.QUERIES
ORACLE_SQL = relational.ORACLE_SQL
