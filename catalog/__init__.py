"""Registered queries with their SQL twins."""

from . import q_analysis, q_flagship, q_references, q_relational, q_structure, q_text  # noqa: F401
from .registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
