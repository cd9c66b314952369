"""Versioned code-knowledge-graph analytics on Spark DataFrames."""
