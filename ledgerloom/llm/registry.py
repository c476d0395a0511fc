"""The queries of this subpackage, their SQL, and the corpus pipeline."""

from __future__ import annotations

from . import queries as q

QUERIES = {name: getattr(q, name) for name in dir(q) if name.startswith("op") and name[2:3].isdigit()}
ORACLE_SQL = q.ORACLE_SQL
