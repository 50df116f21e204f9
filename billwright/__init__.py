"""Spark jobs over billing documents: extraction, checks, matching, roll-ups."""

from billwright.config import CORRECTED, REFERENCE, RuleSet, Semantics

__all__ = ["CORRECTED", "REFERENCE", "RuleSet", "Semantics"]
