"""All driver queries; importing the modules registers them."""

from aeroquant.plans import analysis, basics, folding, modeling, updating  # noqa: F401
from aeroquant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
