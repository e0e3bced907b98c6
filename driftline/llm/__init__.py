"""Training-data operators: filtering, scoring, deduplication, archives, tokens and packing."""
