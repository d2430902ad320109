"""Passage-affinity analytics on Spark."""
