"""Operators of a training-data pipeline: filters, deduplication, scoring, search, archives, mixing."""
