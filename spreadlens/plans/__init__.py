"""Registered queries and their oracle SQL."""
from .registry import ORACLES, QUERIES  # noqa: F401
