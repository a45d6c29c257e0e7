"""Recommendation data work on Spark: features, graphs, retrieval, models, streams."""
