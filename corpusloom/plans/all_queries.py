"""Imports every module that registers queries."""

from __future__ import annotations

from corpusloom.plans import corpus_queries, metric_queries, retrieval_queries  # noqa: F401
from corpusloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
