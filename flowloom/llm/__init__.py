"""Operators for training-data pipelines: filtering, deduplication, mixing, sharding and formatting."""
