"""Operators for building training data: search, archives, mixing, privacy, packing, deduplication, filters."""
