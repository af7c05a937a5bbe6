"""Operators for preparing training data: search, tokens, quality, mixing, toxicity and deduplication."""
