"""All registered queries of the engine."""

from __future__ import annotations

from loculus.plans import answer_queries, belief_queries, family_queries, label_queries, process_queries, space_queries  # noqa: F401
from loculus.plans import answers_sql  # noqa: F401, I001, after the queries that it has SQL for
from loculus.plans import lookup_queries  # noqa: F401, after the SQL that it reads
from loculus.plans import build_queries  # noqa: F401, after both
from loculus.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
