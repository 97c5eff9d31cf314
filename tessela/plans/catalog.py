"""All registered queries."""

from tessela.plans import q_features, q_lists, q_models, q_roles, q_streams, q_tables
from tessela.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_features", "q_lists", "q_models", "q_roles", "q_streams", "q_tables"]
