"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from quarryline.plans import analysis, code, corpus, persistence, relational, round_trips, workflows  # noqa: F401
from quarryline.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "mwu_cluster_proportions"
