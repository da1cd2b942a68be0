"""Listing, photo-corpus and price analytics as Spark jobs."""
