"""Spanloom: code-graph and provenance analytics on Spark DataFrames."""
