"""Operators for training-data pipelines, their queries and SQL texts."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
