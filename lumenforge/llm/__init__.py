"""Operators for building training data: packing, deduplication, language ID, mixing, filters, sharding, PII."""
