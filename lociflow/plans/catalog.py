"""Every registered query of the engine and its SQL equivalent."""

from __future__ import annotations

from lociflow.plans import layers, models, panels, tracks, trees, weaving

_PARTS = (tracks, trees, weaving, layers, panels, models)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
