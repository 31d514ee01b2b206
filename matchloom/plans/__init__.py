"""Registered queries over the given tables, with the SQL that checks them."""

from matchloom.plans import history, matching, texts

QUERIES = texts.QUERIES | matching.QUERIES | history.QUERIES
ORACLES = texts.ORACLES | matching.ORACLES | history.ORACLES
