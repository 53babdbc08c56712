"""All registered queries."""

from __future__ import annotations

from feedloom.plans import (  # noqa: F401
    queries_graph,
    queries_ledger,
    queries_measure,
    queries_reports,
    queries_stream,
    queries_turns,
)
from feedloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
