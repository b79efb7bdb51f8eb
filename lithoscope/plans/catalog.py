"""All registered queries and oracles of the library, by name."""

from __future__ import annotations

from . import cohorts, modelling, reports, spectral, statistics, structures, summaries

_PARTS = (spectral, cohorts, statistics, modelling, structures, reports, summaries)

QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
