"""Similarity-join graph analytics as declarative Spark plans."""
