"""Registered queries over the given tables."""

from . import q_audit, q_candidates, q_listings, q_more, q_pages, q_pricing, q_scalars, q_streams, q_titles, q_visual  # noqa: F401
from .registry import CHECKS, QUERIES, expand

ORACLES = {name: expand(sql) for name, sql in CHECKS.items()}

__all__ = ["ORACLES", "QUERIES"]
