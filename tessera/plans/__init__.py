"""Queries over whole tables, each with the same rows in DuckDB's SQL."""

from . import corpus, math

QUERIES = corpus.QUERIES | math.QUERIES
ORACLES = corpus.ORACLES | math.ORACLES
