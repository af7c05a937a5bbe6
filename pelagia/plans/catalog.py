"""All registered queries; importing the plan modules fills the registry."""

from pelagia.plans import (  # noqa: F401
    audit_plans,
    ecology_plans,
    enrich_plans,
    function_plans,
    hits_plans,
    matrix_plans,
    reference_plans,
    sequence_plans,
    source_plans,
    spatial_plans,
    stats_plans,
)
from pelagia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
