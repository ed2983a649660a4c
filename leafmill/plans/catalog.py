"""All registered queries with their oracle SQL."""

from __future__ import annotations

from leafmill.plans import gates, geometry, masked, outlines, records, shelves, streams, texts, voices  # noqa: F401
from leafmill.plans.registry import ORACLES, QUERIES  # noqa: F401
