"""Training-data operators: tokens, media, deduplication, scoring, mixing, sharding."""
