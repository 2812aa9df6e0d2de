"""Every query of the engine; importing the modules registers them."""

from tempora.plans import align_queries, catalog_queries, decision_queries, format_queries, interval_queries, library_queries, media_queries  # noqa: F401
from tempora.plans.registry import ORACLE, QUERIES  # noqa: F401
