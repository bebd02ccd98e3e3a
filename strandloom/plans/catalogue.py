"""All registered queries of the library proper."""

from strandloom.plans import aggregated, aligned, contract, editorial, flagship, ingest, joined, korean, membership, ordered, repaired, textual  # noqa: F401
from strandloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
