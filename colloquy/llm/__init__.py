"""Training-data operators: scoring, tokenising, near-duplicate search, sharding, mixing and redaction."""
