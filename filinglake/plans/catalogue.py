"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from filinglake.plans import company, corpus, streams, vectors, web

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (web, company, corpus, vectors, streams):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
