"""All registered queries."""

from __future__ import annotations

from cvebeacon.plans import (  # noqa: F401
    cleaning,
    enrichment,
    evaluation,
    extraction,
    merging,
    modelling,
    web,
)
from cvebeacon.plans.enrichment import epss_status_by_source as flagship
from cvebeacon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
