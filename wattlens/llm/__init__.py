"""Operators that prepare training data: sharding, deduplication, language, privacy, extraction, tokens, mixing, packing."""
