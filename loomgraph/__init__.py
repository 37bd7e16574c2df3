"""Loomgraph: knowledge-graph and vector retrieval operators as Spark DataFrame transformations."""
