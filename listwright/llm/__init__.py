"""Operators of a training-data pipeline: counts, dedup, search, token files, mixing, models."""
