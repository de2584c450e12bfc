"""All queries outside the llm subpackage, by name, and their SQL."""

from __future__ import annotations

from motifold.plans.oracles import ORACLES
from motifold.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
