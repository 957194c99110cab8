"""Registered queries, grouped by layer."""

from . import cohort, compose, encounters, evaluate, records, retrieve, texts
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "cohort", "compose", "encounters", "evaluate", "records", "retrieve", "texts"]
