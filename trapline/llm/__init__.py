"""Operators of a training-data pipeline: deduplication, decontamination, quality, secrets, packing, shards."""
