"""Registry of the engine's contract queries: QUERIES (Spark) and ORACLES (DuckDB SQL)."""

from __future__ import annotations

from graphloom.plans import catalog_graph, catalog_models, catalog_more, catalog_sources, catalog_sparql

QUERIES = {**catalog_sparql.QUERIES, **catalog_graph.QUERIES, **catalog_models.QUERIES, **catalog_sources.QUERIES, **catalog_more.QUERIES}
ORACLES = {**catalog_sparql.ORACLES, **catalog_graph.ORACLES, **catalog_models.ORACLES, **catalog_sources.ORACLES, **catalog_more.ORACLES}


def flagship(spark, sf_dir):
    """Customers by region through mapping, reasoning and SPARQL."""
    return QUERIES["sparql_flagship"](spark, sf_dir)
