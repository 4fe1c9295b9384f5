"""Registered queries (Spark builders + oracle SQL). Importing this package fills the registry."""

from vellum.plans import catalog, catalog_features, catalog_more, catalog_programs, catalog_similarity, catalog_tables  # noqa: F401
from vellum.plans.registry import REGISTRY, Query  # noqa: F401
