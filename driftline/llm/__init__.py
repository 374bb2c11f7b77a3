"""Training-data operators: mixing, deduplication, filtering, scoring, token counts."""
