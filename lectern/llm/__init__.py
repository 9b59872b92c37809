"""Training-data operators: deduplication, filtering, mixing, scoring and token output."""
