"""All registered queries and their SQL twins."""

from __future__ import annotations

from pathloom.plans import feature_queries, learning_queries, path_queries, position_queries, scene_queries

MODULES = [path_queries, feature_queries, position_queries, scene_queries, learning_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
