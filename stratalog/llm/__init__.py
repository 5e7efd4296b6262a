"""Operators for training-data pipelines: mixing, language ID, toxicity, near-dedup, formatting, extraction, sharding, packing, top-k."""
