"""Named queries over the driver's tables, each with its SQL twin where SQL has one."""

from __future__ import annotations

from . import codecs, matrices, results, studies

_MODULES = (matrices, codecs, studies, results)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
