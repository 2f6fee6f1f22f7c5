"""Operators for building training data: scoring, filtering, deduplication, search and output."""
