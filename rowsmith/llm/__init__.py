"""Operators of a training-data pipeline: packing, deduplication, filters, tokens and shards."""
