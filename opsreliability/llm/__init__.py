"""Operators for training-data pipelines: deduplication, packing, scans, sharding, scoring."""
