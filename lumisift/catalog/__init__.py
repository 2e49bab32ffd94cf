"""Every operator as a query over the given tables, most with the same result in SQL.

The SQL adds 0.0 to rounded numbers because Spark rounds to 0.0 what SQL rounds to -0.0.
"""

from lumisift.catalog import files, index, manifest, model, search, vectors

_MODULES = (vectors, search, manifest, files, index, model)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
