"""Named queries, one module per family."""

from billwright.plans import archive, documents, intake, ledger, parties, places, quality, streams, texts  # noqa: F401
from billwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
