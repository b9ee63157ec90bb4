"""Operators for building training data: scoring, deduplication, sharding, mixing, tokenising, archives."""
