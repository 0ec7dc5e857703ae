"""Registered queries; importing this package fills the catalog."""

from wearline.plans import audit, consolidation, detection, health, manifest, rul, signals, streams, survival, trajectory  # noqa: F401
from wearline.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
