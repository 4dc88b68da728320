"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from . import definitions, lifecycle, merging, routing, waiting

_MODULES = (routing, merging, waiting, lifecycle, definitions)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
