"""Imports every query module, which fills the registry."""

from exprspark.plans import assay_queries, cohort_queries, intake_queries  # noqa: F401
from exprspark.plans.registry import ORACLES, QUERIES  # noqa: F401
