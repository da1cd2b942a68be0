"""Operators of a training-data pipeline: filters, near-duplicates, scoring, mixing."""
