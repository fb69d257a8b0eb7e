"""Registered queries: name to ``f(spark, sf_dir)``, and the DuckDB SQL of those that SQL can express."""

from lectern.plans import catalog_graph, catalog_model, catalog_relational  # noqa: F401  (they register)
from lectern.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
