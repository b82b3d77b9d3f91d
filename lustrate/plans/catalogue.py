"""The library's queries by name, and the SQL that must give the same rows."""

from lustrate.plans import container_queries, evidence_queries, ledger_queries, structured_queries, text_queries

PARTS = (text_queries, structured_queries, container_queries, evidence_queries, ledger_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
