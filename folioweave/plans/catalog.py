"""Imports every plan module so that its queries are registered."""

from folioweave.plans import behaviour, corpus, evidence, graph, search, stores, streams, structure  # noqa: F401
from folioweave.plans.registry import all_queries, all_sql  # noqa: F401
