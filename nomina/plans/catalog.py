"""Import every query module so the registry is populated."""

from nomina.plans import (  # noqa: F401
    q_aggregates, q_derived, q_mapping, q_pipelines, q_quality, q_relational, q_scalar, q_sources, q_stats, q_streaming, q_web)
from nomina.plans.registry import ORACLES, QUERIES  # noqa: F401
