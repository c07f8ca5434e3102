"""The queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from corpusloom.llm import queries
from corpusloom.llm.oracles import ORACLES

QUERIES = queries.QUERIES

__all__ = ["ORACLES", "QUERIES"]
