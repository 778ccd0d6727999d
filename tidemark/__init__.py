"""Tidemark: timeline, tracking and retrieval analytics on Spark DataFrames."""
