"""Catalog, lineage and retrieval analytics expressed as Spark DataFrames."""
