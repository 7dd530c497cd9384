"""Operators of a training-data pipeline: deduplication, cleaning, language, mixing, sharding and token output."""
