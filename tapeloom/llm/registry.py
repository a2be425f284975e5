"""All queries of this subpackage with their SQL."""

from __future__ import annotations

from tapeloom.llm import consensus, duplicates, mixing, overlap, packing, sampling, splits, terms, truncation

MODULES = [sampling, duplicates, overlap, terms, splits, consensus, packing, mixing, truncation]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
