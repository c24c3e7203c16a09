"""Import every query module so that the registry is complete."""

from __future__ import annotations

from . import q_features, q_listings, q_models, q_sources, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
