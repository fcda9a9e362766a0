"""Operators of a training-data pipeline: scoring, filtering, deduplication, packing and formatting of text."""
