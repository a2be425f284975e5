"""All queries of the core; importing the modules registers them."""

from tapeloom.plans import run_queries, score_queries, split_queries, text_queries  # noqa: F401
from tapeloom.plans.registry import OPERATORS, QUERIES, SQL

__all__ = ["OPERATORS", "QUERIES", "SQL"]
