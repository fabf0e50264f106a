"""The registered queries."""

from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.plans import audit, model, options, price, text  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
