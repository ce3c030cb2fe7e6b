"""Queries over the sample tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from . import calling, corpus, delivery, evaluation, extraction, preparation, preparing, reads

MODULES = (reads, corpus, evaluation, calling, preparing, preparation, extraction, delivery)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
