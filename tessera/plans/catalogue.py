"""The registered queries and their SQL twins, by name."""

from __future__ import annotations

from tessera.plans import code, graphs, logs, retrieval, state

_MODULES = (retrieval, graphs, logs, code, state)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
