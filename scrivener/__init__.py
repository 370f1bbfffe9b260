"""Batch text intelligence on Spark: cleaning, scoring, matching and review of document tables."""
