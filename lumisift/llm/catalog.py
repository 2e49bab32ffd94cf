"""The dealt operators and the pipeline as queries over the given tables."""

from lumisift.llm import query_dups, query_mix, query_records, query_rules

_MODULES = (query_mix, query_rules, query_dups, query_records)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
