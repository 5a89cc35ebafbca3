"""All registered queries of the engine and their SQL."""

from tessera.plans import business, relational

QUERIES = relational.QUERIES | business.QUERIES
SQL = relational.SQL | business.SQL
