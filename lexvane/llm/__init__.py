"""Operators for large-scale training-data pipelines: quality, search, sharding, near duplicates, filters and packing."""
