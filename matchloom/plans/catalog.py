"""All registered queries and their SQL equivalents, by name."""

from __future__ import annotations

from matchloom.plans import evaluation, fit, ingest, music

QUERIES = ingest.QUERIES | fit.QUERIES | evaluation.QUERIES | music.QUERIES
ORACLE_SQL = ingest.ORACLE_SQL | fit.ORACLE_SQL | evaluation.ORACLE_SQL | music.ORACLE_SQL
