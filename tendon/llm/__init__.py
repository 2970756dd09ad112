"""Training-data operators: scoring, counting, deduplication, redaction, filtering, mixing, extraction."""
