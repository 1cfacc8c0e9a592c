"""Training-data operators: scoring, filtering, deduplication, sharding, mixing and tokenising of text corpora."""
