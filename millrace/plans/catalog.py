"""All workload queries by name."""

from __future__ import annotations

from . import auction, basics, campaign, cluster, equipment, grid, inputs, measures, roads, streams
from .registry import ORACLES, QUERIES

MODULES = (campaign, cluster, grid, roads, equipment, auction, basics, streams, inputs, measures)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
