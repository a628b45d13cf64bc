"""Operators of a training-data pipeline: deduplication, quality, secrets, packing and mixing."""
