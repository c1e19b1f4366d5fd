"""All registered queries over the driver's tables, with their SQL."""

from waymark.plans import decode, rules, scores, texts, times  # noqa: F401  (registers)
from waymark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
