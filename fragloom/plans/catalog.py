"""Imports every query module so that the registry is complete."""

from fragloom.plans import contract_queries, dataset_queries, fragment_queries, layout_queries, link_queries, media_queries, ml_queries, recovery_queries, sink_queries, token_queries  # noqa: F401
from fragloom.plans.registry import ORACLES, QUERIES  # noqa: F401
