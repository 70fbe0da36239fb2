"""Registered queries and their SQL oracles."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
